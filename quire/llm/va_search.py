"""Exact top-k by inner product with vector-approximation files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.grid import nearest, usable


def approximate(points: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantised cells of integer vectors, and the least and largest step of each cell.

    ``cells`` is one byte per component; component ``d`` of a vector in cell
    ``c`` lies in ``[low[d, c], high[d, c]]``.
    """
    least = points.min(axis=0)
    span = points.max(axis=0) - least + 1
    n = 1 << bits
    cells = ((points - least) * n // span).astype(np.uint8)
    c = np.arange(n)[None, :]
    low = least[:, None] - (-c * span[:, None] // n)
    high = least[:, None] + ((c + 1) * span[:, None] - 1) // n
    return cells, low, high


def search_block(k: int, bits: int, tile: int = 128, step: int = 64):
    """The scorer of one pair of blocks: bounds from cells, then exact vectors in bound order."""

    def score(ids: np.ndarray, points: np.ndarray, qids: np.ndarray, asked: np.ndarray):
        cells, low, high = approximate(points, bits)
        at = np.arange(points.shape[1])[None, :]
        middle = ((low + high) / 2)[at, cells]
        half = ((high - low) / 2)[at, cells]
        rows, cols, scores = [], [], []
        for first in range(0, len(qids), tile):
            q = asked[first:first + tile].astype(np.float64)
            centre, slack = q @ middle.T, np.abs(q) @ half.T
            upper, lower = centre + slack, centre - slack
            own = ids[None, :] == qids[first:first + tile, None]
            upper[own] = lower[own] = -np.inf
            sure = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(q), -np.inf)
            for i in range(len(q)):
                near = np.flatnonzero((upper[i] >= sure[i]) & (upper[i] > -np.inf))
                near = near[np.argsort(-upper[i, near], kind="stable")]
                exact = np.zeros(0, np.int64)
                read = 0
                while read < len(near):
                    if read >= k and np.partition(exact, read - k)[read - k] > upper[i, near[read]]:
                        break
                    exact = np.concatenate([exact, points[near[read:read + step]] @ asked[first + i]])
                    read = len(exact)
                best = np.lexsort((near[:read], -exact))[:k]
                rows.append(np.full(len(best), first + i))
                cols.append(near[best])
                scores.append(exact[best])
        return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)

    return score


def va_top_k(
    df: DataFrame, query: Column, k: int = 20, scale: int = 64, bits: int = 5,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """The ``k`` largest integer inner products of each query: ``query_id, rank, vec_id, score``.

    Every component x becomes floor(scale * x). Each block of vectors keeps a
    vector-approximation file: one ``bits``-wide cell per component. A query
    scans the cells for an upper and a lower bound of every score, drops what
    lies below the ``k``-th best lower bound, and reads exact vectors in the
    order of their upper bound until the ``k``-th result is certain.

    ``query`` is a condition on ``vec_id``. A vector is no candidate of its own
    id. Fewer than ``k`` candidates: all of them. Null ids and vectors that are
    null, empty or hold null or non-finite components take no part, vectors of
    another length do not meet. Rows that repeat an id are candidates each for
    itself; as queries they share one list. Other columns, whatever their names,
    are ignored. Scores are 64-bit integers.
    """
    steps = F.transform(F.col(embedding).cast("array<double>"), lambda x: F.floor(x * scale).cast("long"))
    vectors = usable(df, vec_id, embedding, steps)
    return nearest(vectors, query, search_block(k, bits), k, ascending=False, score_type="long")
