"""Models as stages of a query: loaded once per Python worker, fed with texts of like length.

A model pads the texts of a batch to the longest one, so every Arrow batch is
sorted by length before it is cut into small ones, and results go back to their
rows: what a row gets does not depend on its neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from quire.functions.encoding import VECTOR_TYPE, Encoder

ARROW = 4096  # rows handed to a model stage at once


class Scorer(Protocol):
    """``score`` gives one number per pair of query and passage."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


def by_length(lengths: list[int], size: int) -> Iterator[np.ndarray]:
    """Positions in groups of ``size``, shortest first; equal lengths keep their order."""
    order = np.argsort(np.array(lengths, np.int64), kind="stable")
    for i in range(0, len(order), size):
        yield order[i:i + size]


def cut_words(text: str, most: int) -> str:
    """The first ``most`` words of a text with what stands between them."""
    for n, word in enumerate(re.finditer(r"\S+", text), 1):
        if n == most:
            return text[:word.end()]
    return text


@dataclass(frozen=True)
class ModelEncoder:
    """An encoder that each worker loads for itself by ``load``.

    ``batch`` texts are encoded at once. ``most_tokens`` is the limit of the
    model, applied by ``cut``; without it texts are encoded whole. It can stand
    wherever an encoder can.
    """

    load: Callable[[], Encoder]
    batch: int = 8
    most_tokens: int | None = None
    cut: Callable[[str, int], str] = cut_words

    def column(self, text: Column) -> Column:
        load, batch, most, cut = self.load, self.batch, self.most_tokens, self.cut

        # the stage wants its type as an object
        vectors = StructType.fromDDL(VECTOR_TYPE.removeprefix("struct<").removesuffix(">"))

        def make() -> Callable:
            encoder = load()

            def predict(texts: np.ndarray) -> list[dict]:
                given = [str(x) if most is None else cut(str(x), most) for x in texts]
                out: list[dict] = [{}] * len(given)
                for at in by_length([len(x) for x in given], batch):
                    dense, sparse = encoder.encode([given[i] for i in at])
                    for i, row, s in zip(at, dense, sparse, strict=True):
                        out[i] = {
                            "dense": np.asarray(row, np.float32), "terms": np.fromiter(s.keys(), np.int64, len(s)),
                            "weights": np.fromiter(s.values(), np.float32, len(s))}
                return out

            return predict

        return predict_batch_udf(make, return_type=vectors, batch_size=ARROW)(F.coalesce(text, F.lit("")))


def model_scorer(load: Callable[[], Scorer], batch: int = 8) -> Callable[[Column, Column], Column]:
    """A scorer for ``rerank`` that each worker loads for itself; ``batch`` pairs are scored at once."""

    def make() -> Callable:
        scorer = load()

        def predict(queries: np.ndarray, texts: np.ndarray) -> np.ndarray:
            out = np.zeros(len(texts))
            for at in by_length([len(q) + len(t) for q, t in zip(queries, texts, strict=True)], batch):
                out[at] = scorer.score([(str(queries[i]), str(texts[i])) for i in at])
            return out

        return predict

    stage = predict_batch_udf(make, return_type=DoubleType(), batch_size=ARROW)
    return lambda query, text: stage(F.coalesce(query, F.lit("")), F.coalesce(text, F.lit("")))
