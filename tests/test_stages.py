"""Which stage runs for which document, and that the tables say the same as a run from scratch."""

import random

import pytest
from pyspark.sql import functions as F

from quire import schemas
from quire.plans.build import build, passages
from quire.plans.stages import Stages
from quire.sources.store import Store

DOC = "key string, title string, kind string, source string, slot bigint, text string, skip_pages array<" + schemas.RANGE + ">, body_end_page int, auto array<string>"
BODY = "A wave on a line travels with the speed that the medium around its conductors decides for it. " * 9


def frame(spark, docs):
    return spark.createDataFrame(
        [(k, title, "article", "tests", slot, f"# SOURCE: x\n\n[PAGE 1]\n{text} {BODY}", [], None, []) for k, (title, slot, text) in docs.items()], DOC)


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "index"), shards=3)


def ran(state):
    return {r["key"]: (r["clean"], r["chunk"]) for r in state.collect() if r["clean"] or r["chunk"]}


def chunk_rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_only_stages_with_another_stamp_run(spark, store):
    docs = {f"d{i}": (f"Title {i}", i, f"text {i}") for i in range(6)}
    stages = Stages(store)
    assert ran(stages.run(frame(spark, docs))) == {k: (True, True) for k in docs}
    assert ran(stages.run(frame(spark, docs))) == {}
    docs["d1"] = ("Another title", 1, "text 1")
    docs["d2"] = ("Title 2", 2, "another text")
    docs["d3"] = ("Title 3", 33, "text 3")
    docs["d9"] = ("Title 9", 9, "text 9")
    assert ran(stages.run(frame(spark, docs))) == {"d1": (False, True), "d2": (True, True), "d3": (False, True), "d9": (True, True)}
    want = passages(frame(spark, docs))
    assert chunk_rows(stages.passages(frame(spark, docs).select("key"))) == chunk_rows(want)
    assert ran(stages.run(frame(spark, {"d0": docs["d0"]}), force=True)) == {"d0": (True, True)}


def test_cleaning_is_not_done_again_for_a_title(spark, store):
    """The cleaned text is planted: what is cut after a new title comes from the table."""
    docs = {"a": ("One", 0, "first"), "b": ("Two", 1, "second")}
    stages = Stages(store)
    stages.run(frame(spark, docs))
    planted = stages.table("clean").withColumn("clean_text", F.replace("clean_text", F.lit("first"), F.lit("planted")))
    spark.createDataFrame(planted.collect(), planted.schema).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(stages.path("clean"))
    docs["a"] = ("Uno", 0, "first")
    stages.run(frame(spark, docs))
    texts = {r["book"]: r["embed_text"] for r in stages.passages(frame(spark, docs).select("key")).filter("id % 1048576 = 0").collect()}
    assert "planted" in texts["a"] and "Uno" in texts["a"] and "second" in texts["b"]


def test_random_changes_end_where_a_fresh_run_ends(spark, store, tmp_path):
    r = random.Random(3)
    docs = {}
    stages = Stages(store)
    for _ in range(4):
        for i in range(5):
            if r.random() < 0.6:
                docs[f"d{i}"] = (r.choice("xyz"), r.choice([i, i + 10]), r.choice(["p", "q"]))
        stages.run(frame(spark, docs))
        gone = [k for k in docs if r.random() < 0.2]
        stages.remove(spark.createDataFrame([(k,) for k in gone], "key string"))
        for k in gone:
            del docs[k]
    if docs:
        fresh = Stages(Store(spark, str(tmp_path / "fresh"), shards=2))
        fresh.run(frame(spark, docs))
        keys = frame(spark, docs).select("key")
        assert chunk_rows(stages.passages(keys)) == chunk_rows(fresh.passages(keys))
    assert {r["key"] for r in stages.table("chunk").collect()} == {r["key"] for r in stages.table("clean").collect()} == set(docs)


def test_build_stops_before_the_index(spark, store):
    docs = {"a": ("One", 0, "first"), "b": ("Two", 1, "second")}
    assert build(frame(spark, docs), store, load=False).count() == 0 and store.count() == 0
    assert Stages(store).table("chunk").count() == 2
    assert build(frame(spark, docs), store).count() == 2 and store.count() > 0
    assert build(frame(spark, docs), store).count() == 0
    n = store.count()
    assert build(frame(spark, docs), store, recreate=True).count() == 2 and store.count() == n
