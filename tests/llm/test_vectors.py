"""Exact top-k and int8 neighbours against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import int8_join, va_search
from quire.llm.grid import nearest, usable

SCHEMA = "vec_id long, embedding array<float>, score int, rank string"


def rows(n, dim, seed, odd=True):
    r = random.Random(seed)
    out = [(i, [r.uniform(-1, 1) for _ in range(dim)], 1, "x") for i in range(n)]
    out += [(n + i, out[i][1], 2, None) for i in range(n // 4)]  # the same vectors again
    if odd:
        out += [
            (None, [1.0] * dim, 0, ""), (5000, None, 0, ""), (5001, [], 0, ""), (5020, [float("nan")] * dim, 0, ""),
            (5040, [float("inf")] + [0.0] * (dim - 1), 0, ""), (5060, [None] + [0.5] * (dim - 1), 0, ""),
            (5080, [0.0] * dim, 0, ""), (5100, [0.5] * (dim + 1), 0, ""), (5200, [0.25] * (dim + 1), 0, ""), out[0], out[20],
            (20, [0.75] * dim, 0, ""), (3, [0.9] * dim, 0, ""), (3, [-0.9] * dim, 0, ""),
        ]
    return out


def fit(rows, zero):
    """Rows that can take part; an id may repeat."""
    kept = []
    for i, v, *_ in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or (not zero and not any(v)):
            continue
        kept.append((i, np.array(v, np.float32).astype(float).tolist()))
    return kept


def brute(kept, query, k, score, ascending):
    out = []
    for q in sorted({i for i, _ in kept if query(i)}):
        found = [(score(x, v), i) for j, x in kept if j == q for i, v in kept if i != q and len(v) == len(x)]
        found.sort(key=lambda x: (x[0] if ascending else -x[0], x[1]))
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def inner(a, b):
    return sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(a, b, strict=True))


def euclid(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += (x - y) * (x - y)
    return math.sqrt(total)


def got(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("dim,bits,seed", [(3, 2, 1), (8, 5, 2), (16, 8, 3)])
def test_va_top_k(spark, dim, bits, seed):
    data = rows(150, dim, seed)
    df = spark.createDataFrame(data, SCHEMA)
    want = brute(fit(data, True), lambda i: i % 20 == 0, 7, inner, False)
    assert got(va_search.va_top_k(df, F.col("vec_id") % 20 == 0, k=7, bits=bits)) == want


@pytest.mark.parametrize("dim,seed", [(2, 4), (8, 5), (33, 6)])
def test_int8_neighbours(spark, dim, seed):
    data = rows(150, dim, seed)
    df = spark.createDataFrame(data, SCHEMA)
    want = brute(fit(data, False), lambda i: i % 10 == 0, 6, euclid, True)
    assert got(int8_join.int8_neighbours(df, F.col("vec_id") % 10 == 0, k=6)) == want


def test_blocks_of_any_size_give_the_same(spark):
    data = rows(120, 6, 7, odd=False)
    df = usable(spark.createDataFrame(data, SCHEMA), "vec_id", "embedding")
    q = F.col("vec_id") % 3 == 0
    want = brute(fit(data, False), lambda i: i % 3 == 0, 5, euclid, True)
    for vectors, queries in ((1000, 1000), (13, 7), (50, 1)):
        assert got(nearest(df, q, int8_join.join_block(5, 4, 16), 5, True, "double", vectors, queries)) == want


def test_no_rows_and_few_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    two = spark.createDataFrame([(0, [1.0, 0.0], 0, ""), (20, [0.0, 1.0], 0, "")], SCHEMA)
    for op in (va_search.va_top_k, int8_join.int8_neighbours):
        assert got(op(none, F.col("vec_id") % 20 == 0)) == []
        assert {x[:3] for x in got(op(two, F.col("vec_id") % 20 == 0))} == {(0, 1, 20), (20, 1, 0)}


def test_cells_bound_every_component():
    x = np.random.default_rng(8).integers(-90, 90, (300, 5))
    for bits in (1, 3, 8):
        cells, low, high = va_search.approximate(x, bits)
        at = np.arange(5)[None, :]
        assert (low[at, cells] <= x).all() and (x <= high[at, cells]).all()
