"""Corpus-to-passage retrieval analytics as PySpark DataFrame pipelines."""

from quire.config import Settings

__all__ = ["Settings"]
