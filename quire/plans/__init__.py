"""Whole-corpus plans composed from the operators."""
