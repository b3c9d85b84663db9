"""Nearest neighbours by a block matrix join of int8 tiles."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.grid import nearest, usable


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors, their scale, the length of the quantised vector and of what it misses."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    small = np.rint(x / scale[:, None]).astype(np.int8)
    shown = small * scale[:, None]
    return small, scale, np.sqrt((shown**2).sum(axis=1)), np.sqrt(((x - shown) ** 2).sum(axis=1))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of row pairs, summed in component order."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        step = a[:, d] - b[:, d]
        total += step * step
    return np.sqrt(total)


def join_block(k: int, query_tile: int = 256, vector_tile: int = 2048):
    """The scorer of one pair of blocks.

    For x = s*i + e the product of two vectors differs from the product of
    their int8 forms by at most |q'| |e| + |e'| |x|, which bounds the distance
    from both sides. int8 products are summed in float32, which holds them
    exactly up to 1,040 components (float64 beyond).
    """

    def score(ids: np.ndarray, points: np.ndarray, qids: np.ndarray, asked: np.ndarray):
        exact = np.float32 if points.shape[1] <= 1040 else np.float64
        pi, ps, _, pe = quantise(points)
        qi, qs, qn, qe = quantise(asked)
        pp, qq = (points**2).sum(axis=1), (asked**2).sum(axis=1)
        pn = np.sqrt(pp)
        rows, cols, scores = [], [], []
        for q0 in range(0, len(qids), query_tile):
            q = slice(q0, q0 + query_tile)
            width = len(qids[q])
            heaps: list[list] = [[] for _ in range(width)]
            bound = np.full(width, np.inf)  # of the k-th squared distance so far
            for p0 in range(0, len(ids), vector_tile):
                p = slice(p0, p0 + vector_tile)
                product = (qi[q].astype(exact) @ pi[p].astype(exact).T).astype(np.float64)
                product *= qs[q, None] * ps[None, p]
                error = 2 * (qn[q, None] * pe[None, p] + qe[q, None] * pn[None, p])
                size = qq[q, None] + pp[None, p]
                square = size - 2 * product
                error += 1e-9 * size  # rounding
                own = ids[None, p] == qids[q, None]
                upper = np.where(own, np.inf, square + error)
                if upper.shape[1] >= k:
                    bound = np.minimum(bound, np.partition(upper, k - 1, axis=1)[:, k - 1])
                near, at = np.nonzero((square - error <= bound[:, None]) & ~own)
                far = distance(asked[q0 + near], points[p0 + at])
                for i, j, d in zip(near.tolist(), (p0 + at).tolist(), far.tolist(), strict=True):
                    # ids ascend within a block, so a row number breaks ties as the id does
                    item = (-d, -j)
                    if len(heaps[i]) < k:
                        heapq.heappush(heaps[i], item)
                    elif item > heaps[i][0]:
                        heapq.heapreplace(heaps[i], item)
                full = [i for i in range(width) if len(heaps[i]) == k]
                bound[full] = np.minimum(bound[full], [heaps[i][0][0] ** 2 * (1 + 1e-9) for i in full])
            for i, heap in enumerate(heaps):
                heap.sort(reverse=True)
                rows += [q0 + i] * len(heap)
                cols += [-j for _, j in heap]
                scores += [-d for d, _ in heap]
        return np.array(rows, int), np.array(cols, int), np.array(scores, float)

    return score


def int8_neighbours(
    df: DataFrame, query: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest vectors of each query: ``query_id, rank, vec_id, score`` (Euclidean).

    Vectors and queries meet in blocks. Tiles of int8 products give distances
    with a bound of the quantisation error; pairs whose lower bound beats the
    ``k``-th upper bound are recomputed in double precision on the original
    vectors and merged by heaps, first within a block, then over blocks. The
    bounds are safe, so nothing is lost: recall is 1.

    ``query`` is a condition on ``vec_id``. A vector is no candidate of its own
    id; ties go to the smaller id; fewer than ``k`` candidates: all of them.
    Null ids and vectors that are null, empty, zero or hold null or non-finite
    components take no part, vectors of another length do not meet. Rows that
    repeat an id are candidates each for itself; as queries they share one list.
    Other columns, whatever their names, are ignored.
    """
    some = F.exists(F.col(embedding).cast("array<double>"), lambda x: x != 0)
    vectors = usable(df.where(some), vec_id, embedding)
    return nearest(vectors, query, join_block(k), k, ascending=True, score_type="double")
