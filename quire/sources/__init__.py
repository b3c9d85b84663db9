"""Readers and writers: page sources, marked text, chunk lines, index tables."""
