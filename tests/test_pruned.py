"""Pruned searches against a full one, on kind and on adversarial vectors."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import pruned as P
from quire.operators import retrieval as R

SPARSE = "id bigint, terms array<bigint>, weights array<float>, kind string"


def rows(df):
    return sorted((r["qid"], r["rank"], r["id"], r["score"]) for r in df.collect())


def full(points, queries, n, **on):
    return rows(R.nearest(points, queries, n, **on).select("qid", "id", "score", "rank"))


def sparse_points(spark, seed, count, vocabulary, negative=False):
    r = random.Random(seed)
    out = []
    for i in range(count):
        words = {min(vocabulary - 1, int(r.expovariate(0.05))) for _ in range(r.randint(0, 12))}
        weight = lambda: float(r.randint(-3 if negative else 1, 40 if r.random() < 0.02 else 4))
        out.append((i, sorted(words), [weight() for _ in words], "ab"[i % 2]))
    return spark.createDataFrame(out, SPARSE).repartition(5)


@pytest.mark.parametrize("negative", [False, True])
def test_sparse_search_is_exact(spark, monkeypatch, negative):
    monkeypatch.setattr(P, "BLOCK", 64)
    points, queries = sparse_points(spark, 1, 3000, 120, negative), sparse_points(spark, 2, 40, 120, negative).withColumnRenamed("id", "qid")
    hits, visits = P.sparse_search(P.postings(points), queries, 7)
    assert rows(hits) == full(points, queries, 7, dense=False)
    seen = visits.agg(F.sum("cells"), F.sum("cells_read")).first()
    assert 0 < seen[1] <= seen[0]


def test_blocks_without_heavy_weights_are_skipped(spark, monkeypatch):
    """One block in a hundred holds large weights; the others cannot reach them and are not read."""
    monkeypatch.setattr(P, "BLOCK", 50)
    points = spark.range(5000).select("id", F.array(F.lit(7).cast("bigint")).alias("terms"), F.array(F.when(F.expr("id div 50 % 100 = 3"), 9.0).otherwise(1.0).cast("float")).alias("weights"))
    queries = spark.createDataFrame([(1, [7], [1.0])], "qid bigint, terms array<bigint>, weights array<double>")
    hits, visits = P.sparse_search(P.postings(points), queries, 10)
    assert [r["id"] for r in sorted(hits.collect(), key=lambda r: r["rank"])] == list(range(150, 160))
    seen = visits.first()
    assert (seen["cells"], seen["cells_read"], seen["points_read"]) == (100, 1, 50)


def test_filtered_and_odd_sparse_vectors(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 32)
    points = sparse_points(spark, 3, 800, 40)
    queries = sparse_points(spark, 4, 12, 40).withColumnRenamed("id", "qid")
    kept = points.where("kind = 'a'")
    hits, _ = P.sparse_search(P.postings(points), queries, 9, keep=kept)
    assert rows(hits) == full(kept, queries, 9, dense=False)
    odd = spark.createDataFrame([(1, None, None, "a"), (2, [], [], "a"), (3, [5, 5], [1.0, 2.0], "a"), (4, [5], [None], "a"), (5, [None], [1.0], "a")], SPARSE)
    asked = spark.createDataFrame([(1, [5], [2.0]), (2, None, None), (3, [99], [1.0])], "qid bigint, terms array<bigint>, weights array<double>")
    assert rows(P.sparse_search(P.postings(odd), asked, 3)[0]) == [(1, 1, 3, 6.0)]
    assert rows(P.sparse_search(P.postings(odd.limit(0)), asked, 3)[0]) == []


def test_postings_shuffle_vectors_and_searches_their_lists(spark, monkeypatch):
    """Neither the index nor a search takes a row per entry, or per pair of a query and a point, through a shuffle."""
    plans = {}
    keep = P.stored

    def seen(df, name="table"):
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(P, "stored", seen)
    points, queries = sparse_points(spark, 5, 300, 40), sparse_points(spark, 6, 5, 40).withColumnRenamed("id", "qid")
    hits, _ = P.sparse_search(P.postings(points), queries, 3)
    assert rows(hits) == full(points, queries, 3, dense=False)
    assert "Generate" not in plans["postings"] and "Aggregate" not in plans["postings"]
    for plan in (plans["first"], hits._jdf.queryExecution().optimizedPlan().toString()):
        assert not re.search(r"Aggregate \[qid#\d+L?, id#", plan)


@pytest.mark.parametrize("entries,queries", [(1, 4096), (60, 3)])
def test_cells_of_many_entries_and_many_queries_are_cut(spark, monkeypatch, entries, queries):
    monkeypatch.setattr(P, "ENTRIES", entries)
    monkeypatch.setattr(P, "QUERIES", queries)
    points, asked = sparse_points(spark, 7, 500, 60, True), sparse_points(spark, 8, 20, 60, True).withColumnRenamed("id", "qid")
    index = P.postings(points)
    held = index.lists.select("cell", F.explode("entries").alias("e")).groupBy("cell").agg(
        F.count("*").alias("n"), F.countDistinct("e.id").alias("ids"), F.min("e.id").alias("least"))
    for r in held.collect():
        assert (r["n"] <= entries or r["ids"] == 1) and r["least"] == r["cell"]
    assert index.lists.agg(F.sum("size")).first()[0] == points.select(F.sum(F.size("terms"))).first()[0]
    assert rows(P.sparse_search(index, asked, 6)[0]) == full(points, asked, 6, dense=False)


def test_vectors_of_uneven_arrays(spark):
    """A term without a weight, a weight without a term and nulls inside do not shift the others; large term ids stay whole."""
    big = (1 << 62) + 1
    odd = [(1, [5, big, 7], [1.0, 2.0], "a"), (2, [big], [3.0, 9.0], "a"), (3, [None, big], [8.0, 4.0], "a"), (4, [5, big, 5], [1.0, None, 0.5], "a"), (5, [], [1.0], "a")]
    points = spark.createDataFrame(odd, SPARSE).coalesce(1)
    asked = spark.createDataFrame([(1, [big], [1.0]), (2, [5], [2.0]), (3, [big - 1, 7], [1.0, 1.0])], "qid bigint, terms array<bigint>, weights array<double>")
    index = P.postings(points)
    assert rows(P.sparse_search(index, asked, 5)[0]) == [(1, 1, 3, 4.0), (1, 2, 2, 3.0), (1, 3, 1, 2.0), (2, 1, 4, 3.0), (2, 2, 1, 2.0)]
    assert rows(P.sparse_search(index, asked, 5, keep=spark.range(2, 4))[0]) == [(1, 1, 3, 4.0), (1, 2, 2, 3.0)]


def clouds(spark, seed, count, dim, spread):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(12, dim))
    m = centres[g.integers(0, 12, count)] + spread * g.normal(size=(count, dim))
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id bigint, dense array<double>").repartition(4)


@pytest.mark.parametrize("spread,most", [(0.05, 0.35), (5.0, 1.0)])
def test_dense_search_is_exact(spark, spread, most):
    """Tight clouds are pruned; a featureless cloud is read whole and still right."""
    points = clouds(spark, 1, 2500, 8, spread)
    queries = clouds(spark, 1, 2500, 8, spread).where("id % 60 = 0").withColumnRenamed("id", "qid")
    hits, visits = P.dense_search(P.cells(points, 8, pivots=40, sample=600), queries, 6)
    assert rows(hits) == full(points, queries, 6, sparse=False)
    seen = visits.agg(F.sum("points"), F.sum("points_read")).first()
    assert seen[0] == 2500 * 42 and seen[1] <= most * seen[0]


def test_adversarial_dense_vectors(spark, monkeypatch):
    """Equal, opposite, zero, huge and tiny vectors, cells larger than a task's share, few pivots."""
    monkeypatch.setattr(P, "GROUP", 16)
    r = random.Random(5)
    special = [[1.0, 0.0, 0.0], [-1.0, 0.0, 0.0], [0.0, 0.0, 0.0], [1e30, 0.0, 0.0], [1e-30, 1e-30, 0.0], [1.0, 1e-9, 0.0], [0.6, 0.8, 0.0]]
    vectors = [r.choice(special) if r.random() < 0.7 else [r.uniform(-1, 1) for _ in range(3)] for _ in range(400)]
    points = spark.createDataFrame(list(enumerate(vectors)), "id bigint, dense array<double>")
    queries = spark.createDataFrame(list(enumerate([*special, [0.0, 1.0, 0.0]])), "qid bigint, dense array<double>")
    for pivots in (1, 2, 9):
        hits, _ = P.dense_search(P.cells(points, 3, pivots=pivots), queries, 20)
        assert rows(hits) == full(points, queries, 20, sparse=False)
    few = points.where("id % 7 = 0")
    assert rows(P.dense_search(P.cells(points, 3, pivots=9), queries, 5, keep=few)[0]) == full(few, queries, 5, sparse=False)


def test_odd_dense_vectors_take_no_part(spark):
    odd = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [1.0, math.inf]), (6, [math.nan, 1.0]), (7, [1.0, 1.0])]
    points = spark.createDataFrame(odd, "id bigint, dense array<double>")
    queries = points.withColumnRenamed("id", "qid")
    assert rows(P.dense_search(P.cells(points, 2), queries, 3)[0]) == [(7, 1, 7, 1.0)]
    assert rows(P.dense_search(P.cells(points.limit(0), 2), queries, 3)[0]) == []


def test_bounds_hold():
    g = np.random.default_rng(3)
    for _ in range(200):
        pivot, x, q = P.units(g.normal(size=(3, 4)))
        at = float(pivot @ x)
        bound = P.cell_bounds(q[None], pivot[None], np.array([at]), np.array([at]))[0, 0]
        assert q @ x <= bound + 1e-9
