"""Turning texts into dense and sparse vectors.

Models are plugged in as encoders. The default needs no model: it hashes words,
so its vectors hold whole numbers and scores are reproducible to the last bit.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.config import DEFAULTS
from quire.functions.arrow import by_bytes

VECTOR_TYPE = "struct<dense:array<float>,terms:array<bigint>,weights:array<float>>"


class Encoder(Protocol):
    """``encode`` gives one dense row and one ``{term id: weight}`` per text."""

    def encode(self, texts: list[str]) -> tuple[np.ndarray, list[dict[int, float]]]: ...


@lru_cache(maxsize=1 << 18)
def term_id(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16)


class HashingEncoder:
    """Word counts as the sparse vector, their signed sums per bucket as the dense one."""

    def __init__(self, dim: int = DEFAULTS.dense_dim):
        self.dim = dim

    def encode(self, texts: list[str]) -> tuple[np.ndarray, list[dict[int, float]]]:
        dense = np.zeros((len(texts), self.dim))
        sparse: list[dict[int, float]] = []
        for row, text in enumerate(texts):
            counts = Counter(map(term_id, re.findall(r"\w+", (text or "").lower())))
            sparse.append(counts)
            ids = np.fromiter(counts.keys(), dtype=np.int64, count=len(counts))
            n = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
            sign = np.where((ids >> 16) & 1, 1.0, -1.0)
            dense[row] = np.bincount(ids % self.dim, weights=n * sign, minlength=self.dim)
        return dense, sparse


def vectors(text: Column, encoder: Encoder) -> Column:
    """Vector struct of a text column.

    An encoder that is a stage of its own (``column``, as a ``ModelEncoder`` is)
    is loaded by each worker; any other one is sent to the workers as it is.
    """
    if hasattr(encoder, "column"):
        return encoder.column(text)

    @F.arrow_udf(VECTOR_TYPE)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in by_bytes(batch):
                dense, sparse = encoder.encode(part.to_pylist())
                columns = (
                    (list(dense.astype(np.float32)), pa.float32()),
                    ([np.fromiter(s.keys(), np.int64, len(s)) for s in sparse], pa.int64()),
                    ([np.fromiter(s.values(), np.float32, len(s)) for s in sparse], pa.float32()),
                )
                yield pa.StructArray.from_arrays([pa.array(x, pa.list_(t)) for x, t in columns], ["dense", "terms", "weights"])

    return encode(text)


def embed(passages: DataFrame, text: str = "embed_text", encoder: Encoder | None = None) -> DataFrame:
    """Points: the passages with their vectors, the embedded text dropped.

    Only the text column travels to the Python workers.
    """
    encoder = encoder or HashingEncoder()
    kept = passages.columns if text == "text" else [c for c in passages.columns if c != text]
    return passages.select(*kept, vectors(F.col(text), encoder).alias("_v")).select(*kept, "_v.*")
