"""Plans and hot keys: what must hold when the data does not fit a task."""

import random

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from quire.functions.frames import prefix_sum, small
from quire.operators import catalog as C
from quire.operators import registry as G
from quire.plans.build import passages


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_build_is_map_only(spark, tmp_path):
    rows = [("k", "T", "book", "", 0, [], [], None, "text")] * 4
    schema = (
        "key string, title string, kind string, source string, slot bigint, auto array<string>, "
        "skip_pages array<struct<lo:int,hi:int>>, body_end_page int, text string"
    )
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "docs"))
    text = plan(passages(spark.read.parquet(str(tmp_path / "docs"))))
    assert "Exchange" not in text and "Sort" not in text


def test_no_query_multiplies_rows(spark, sf):
    """No product of two tables anywhere, and nothing broadcast by force."""
    for name in QUERIES:
        text = plan(QUERIES[name](spark, sf))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


@pytest.mark.parametrize("name", ["limit_per_group", "history_window", "rrf_fusion"])
def test_group_limits_come_before_the_shuffle(spark, sf, name):
    assert "WindowGroupLimit" in plan(QUERIES[name](spark, sf))


def test_filters_reach_the_scan(spark, sf):
    from quire.operators.retrieval import payload_filter

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("source", "book").withColumn("source", F.lit("x"))
    text = plan(payload_filter(docs, book="src3").select("doc_id"))
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src3)]" in text
    assert "text" not in text.split("ReadSchema")[1]


def test_prefix_sum_splits_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 9)}", i, rng.randint(0, 5)) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at bigint, v bigint")
    want, total = {}, {}
    for k, i, v in sorted(rows):
        total[k] = total.get(k, 0) + v
        want[i] = total[k]
    got = prefix_sum(df, ["at"], F.col("v"), group=["k"], name="s")
    assert {r["at"]: r["s"] for r in got.collect()} == want
    # the hot key really lies in several ranges
    ranges = df.repartitionByRange(8, "k", "at").withColumn("p", F.spark_partition_id())
    assert ranges.filter("k = 'hot'").select("p").distinct().count() > 2


@pytest.mark.parametrize("turns", [50_000, 300, 0])
def test_unique_keys_with_a_hot_base(spark, monkeypatch, turns):
    """Named in turn, in rounds, and some of both."""
    monkeypatch.setattr(G, "TURNS", turns)
    rng = random.Random(8)
    wanted = [(f"{i:06d}", rng.choice(["doc", "doc", "doc", "a", "a_2", ""])) for i in range(900)]
    taken = [("doc",), ("doc_2",), ("doc_5",), ("a_3",), ("doc_007",)]
    got = G.unique_keys(
        spark.createDataFrame(wanted, "path string, base string"), spark.createDataFrame(taken, "key string")
    ).collect()
    used = {t for t, in taken} | {"a_2"}
    want = {}
    for path, base in wanted:
        base = base or "doc"
        key, n = base, 1
        # a wanted base that looks numbered keeps its name for itself
        while key in used and not (key == "a_2" and base == "a_2" and "a_2" not in want.values()):
            n += 1
            key = f"{base}_{n}"
        used.add(key)
        want[path] = key
    assert {r["path"]: r["key"] for r in got} == want
    assert len({r["key"] for r in got}) == len(got)


def test_free_slots(spark):
    rng = random.Random(2)
    used = sorted(rng.sample(range(400), 250))
    new = [(f"{i:04d}",) for i in range(300)]
    got = G.free_slots(spark.createDataFrame(new, "path string"), spark.createDataFrame([(u,) for u in used], "slot bigint"))
    free = [s for s in range(1000) if s not in set(used)][:300]
    assert [r["slot"] for r in got.orderBy("path").collect()] == free


def test_broadcast_only_when_small(spark):
    df = spark.range(100)
    assert "broadcast" in small(df, 100)._jdf.queryExecution().toString().lower()
    assert "broadcast" not in small(df, 99)._jdf.queryExecution().toString().lower()


def test_history_of_a_hot_conversation(spark):
    turns = spark.range(5000).select(
        F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    got = {r["conv_id"]: r["transcript"] for r in C.history_window(turns).collect()}
    assert got[1].split("\n") == [f"user: {i}" for i in range(3994, 4000)]
    assert got[4500] == "user: 4500"
