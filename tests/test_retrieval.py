"""Search against brute force on small fixtures."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.config import DEFAULTS
from quire.functions.encoding import HashingEncoder, embed
from quire.operators import catalog as C
from quire.operators import retrieval as R

WORDS = [f"w{i}" for i in range(60)]


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(5)
    rows = []
    for i in range(700):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 12)))
        # a third of the passages are copies of one text: ties everywhere
        rows.append((i, f"b{i % 7}", rng.choice(["book", "article"]), f"J Tests / {2020 + i % 3}", "w1 w2 w3" if i % 3 == 0 else text))
    return rows


@pytest.fixture(scope="module")
def points(spark, passages):
    df = spark.createDataFrame(passages, "id bigint, book string, kind string, source string, text string")
    return embed(df, "text").repartition(5).cache()


@pytest.fixture(scope="module")
def queries():
    rng = random.Random(9)
    return [(q, " ".join(rng.choice(WORDS) for _ in range(4))) for q in range(25)] + [(25, "w1 w2 w3"), (26, "unknown"), (27, "")]


def brute(passages, queries, n, keep=lambda p: True):
    encoder, out = HashingEncoder(), {}
    live = [p for p in passages if keep(p)]
    dense, sparse = encoder.encode([p[4] for p in live])
    for qid, text in queries:
        (qd,), (qs,) = encoder.encode([text])
        scores = {"dense": {}, "sparse": {}}
        for p, d, s in zip(live, dense, sparse):
            norm = (d @ d) * (qd @ qd)
            scores["dense"][p[0]] = round(float(d @ qd / np.sqrt(norm)) if norm else 0.0, 6)
            dot = sum(w * s.get(t, 0) for t, w in qs.items())
            if dot > 0:
                scores["sparse"][p[0]] = float(dot)
        for branch, by_id in scores.items():
            ranked = sorted(by_id.items(), key=lambda x: (-x[1], x[0]))[:n]
            out.update({(branch, qid, r): hit for r, hit in enumerate(ranked, 1)})
    return out


def found(df):
    return {(r["branch"], r["qid"], r["rank"]): (r["id"], r["score"]) for r in df.collect()}


def test_nearest(spark, points, passages, queries):
    asked = spark.createDataFrame(queries, "qid bigint, text string")
    got = found(R.nearest(points, R.encode_queries(asked), 20))
    assert got == brute(passages, queries, 20)


def test_more_queries_than_one_block(spark, points, passages, queries):
    asked = spark.createDataFrame(queries, "qid bigint, text string")
    small = replace(DEFAULTS, query_block=4)
    assert found(R.nearest(points, R.encode_queries(asked), 7, settings=small)) == brute(passages, queries, 7)


def test_filter_applies_below_the_branches(spark, points, passages, queries):
    asked = spark.createDataFrame(queries, "qid bigint, text string")
    hits = R.search(points, asked, k=5, kind="article", book="b3", source="tests 2021", rerank_hits=False)
    keep = lambda p: p[2] == "article" and p[1] == "b3" and "2021" in p[3]
    lists = brute(passages, queries, 30, keep)
    for qid, _ in queries:
        total = {}
        for (branch, q, rank), (pid, _) in lists.items():
            if q == qid:
                total[pid] = total.get(pid, 0) + 1 / (60 + rank)
        want = [pid for pid, s in sorted(total.items(), key=lambda x: (-round(x[1], 12), x[0]))[:5]]
        got = [r["id"] for r in hits.filter(F.col("qid") == qid).orderBy("rank").collect()]
        assert got == want


def test_rrf_counts_a_single_branch(spark):
    ranked = spark.createDataFrame(
        [("dense", 1, 10, 1), ("dense", 1, 11, 2), ("sparse", 1, 11, 1), ("sparse", 1, 12, 2)],
        "branch string, qid bigint, id bigint, rank int",
    )
    got = [(r["id"], round(r["score"], 6)) for r in R.fuse(ranked, 5).orderBy("rank").collect()]
    assert got == [(11, round(1 / 62 + 1 / 61, 6)), (10, round(1 / 61, 6)), (12, round(1 / 62, 6))]


def test_rerank_is_stable(spark):
    hits = spark.createDataFrame(
        [(1, 5, "a b", "a b", 1), (1, 4, "a b", "a x", 2), (1, 3, "a b", "a y", 3), (1, 2, "a b", "b a", 4)],
        "qid bigint, id bigint, query string, text string, rank int",
    )
    got = R.rerank(hits, 3).orderBy("rank").collect()
    assert [(r["id"], r["rerank_score"]) for r in got] == [(5, 1.0), (2, 1.0), (4, 0.5)]


@pytest.mark.parametrize("k, want", [(0, (1, 30)), (99, (15, 75)), (6, (6, 30)), (7, (7, 35))])
def test_tool_limits(k, want):
    assert C.tool_limits(k) == want


def test_context(spark):
    rows = [(0, "a", None), (1, "a", None), (2, "a", "1.1"), (3, "a", "1.1"), (4, "a", "1.1"), (5, "b", "1.1")]
    points = spark.createDataFrame(rows, "id bigint, book string, section string").selectExpr(
        "*", "'T' book_title", "'' source", "'s' section_title", "1 page_start", "1 page_end", "'x' text")
    anchors = spark.createDataFrame([(1,), (4,), (77,)], "chunk_id bigint")
    got = sorted((r["chunk_id"], r["id"], r["requested"]) for r in C.context(points, anchors, 1, 99).collect())
    assert got == [(1, 0, False), (1, 1, True), (4, 3, False), (4, 4, True)]
    texts = {r["chunk_id"]: r["rendered"] for r in C.render_context(C.context(points, anchors), anchors).collect()}
    assert texts[77] == "No chunk with id 77."
    assert texts[1] == "[chunk 0] T | s | p.1\nx\n\n---\n\n[chunk 1] <- requested T | s | p.1\nx"


def test_vectors_that_are_not_whole(spark, points, passages, queries):
    """Null, short and infinite vectors leave the dense branch and nothing else."""
    asked = spark.createDataFrame(queries, "qid bigint, text string")
    vectors = R.encode_queries(asked)
    odd = points.limit(4).withColumn("id", F.col("id") + 100_000).withColumn(
        "dense", F.expr("case when id % 3 = 0 then null when id % 3 = 1 then array(1f) else transform(dense, x -> cast('inf' as float)) end"))
    odd = odd.withColumn("terms", F.when(F.col("id") % 2 == 0, F.col("terms"))).withColumn("weights", F.when(F.col("id") % 2 == 0, F.col("weights")))
    mixed = points.unionByName(odd).coalesce(1)
    first = min(q for q, _ in queries)
    asks = vectors.withColumn("dense", F.when(F.col("qid") != first, F.col("dense")))
    got = {k: v for k, v in found(R.nearest(mixed, asks, 20)).items() if k[0] == "dense"}
    assert got == {k: v for k, v in brute(passages, queries, 20).items() if k[0] == "dense" and k[1] != first}
    assert {k for k in found(R.nearest(mixed, asks, 20)) if k[1] == first and k[0] == "sparse"}


def test_two_thousand_queries_scan_once_and_leave_the_texts(spark, tmp_path, points):
    points.withColumn("text", F.repeat("text", 3)).write.parquet(str(tmp_path / "p"))
    table = spark.read.parquet(str(tmp_path / "p"))
    asked = spark.range(2000).select(F.col("id").alias("qid"), F.concat(F.lit("alpha beta "), F.col("id").cast("string")).alias("text"))
    hits = R.search(table, asked, rerank_hits=False)
    assert hits.groupBy("qid").count().count() == 2000
    plan = hits._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    scans = [line for line in plan.split("\n") if "FileScan" in line or "Scan parquet" in line]
    assert len(scans) == 2  # one for the vectors, one for the payload
    joined = plan[:plan.index("FileScan") if "FileScan" in plan else len(plan)]
    assert "SortMergeJoin" not in joined and "ShuffledHashJoin" not in joined


def test_more_passes_give_the_same(spark, points, passages, queries):
    asked = spark.createDataFrame(queries, "qid bigint, text string")
    few = replace(DEFAULTS, query_block=2, query_pass=3)
    assert found(R.nearest(points, R.encode_queries(asked), 7, settings=few)) == brute(passages, queries, 7)
