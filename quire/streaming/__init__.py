"""Incremental builds driven by Structured Streaming."""
