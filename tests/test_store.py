"""Layout of the index on disk: files, pruned reads, crashes between steps."""

import pytest
from pyspark.sql import functions as F

from quire import schemas
from quire.plans import serve
from quire.sources import store as S


def points(spark, slots, per=5):
    rows = [((s << 20) + i, f"d{s}", f"T{s}", "book", "", None, "1.1", "s", 1, 1, 3, f"text {s} {i}", [1.0, float(s)], [s], [1.0]) for s in slots for i in range(per)]
    return spark.createDataFrame(rows, schemas.POINTS)


def manifest(spark, slots):
    return spark.createDataFrame([(s, f"d{s}", f"T{s}", "x", 5, "book", "", None) for s in slots], schemas.MANIFEST)


def load(store, spark, slots):
    store.replace(manifest(spark, slots).select(F.col("key").alias("book"), "slot"), points(spark, slots))
    store.write_manifest(manifest(spark, slots))


@pytest.fixture()
def store(spark, tmp_path):
    return S.Store(spark, str(tmp_path / "index"), shards=4)


def files(store, tmp_path):
    return sorted(p for p in (tmp_path / "index").rglob("points/shard=*/part-*.parquet"))


def test_one_file_per_shard_whatever_the_number_of_documents(spark, store, tmp_path):
    load(store, spark, range(400))
    assert len(files(store, tmp_path)) == 4
    load(store, spark, range(400, 440))
    assert len(files(store, tmp_path)) == 4 and store.count() == 2200


def test_large_shards_have_files_of_bounded_size(spark, store, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "ROWS_PER_FILE", 50)
    load(store, spark, range(200))
    assert 20 <= len(files(store, tmp_path)) <= 60
    assert all(spark.read.parquet(str(p)).count() <= 50 for p in files(store, tmp_path))


def pruned(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [shard" in plan or "PartitionFilters: [(shard" in plan


def test_reads_by_document_and_by_id_name_their_shards(spark, store):
    load(store, spark, range(40))
    one = store.points_of("d7")
    assert pruned(one) and {r["book"] for r in one.filter("book = 'd7'").collect()} == {"d7"}
    anchors = spark.createDataFrame([((7 << 20) + 2,), ((9 << 20) + 1,)], "chunk_id bigint")
    near = store.points_near(anchors)
    assert pruned(near) and near.count() < store.count()
    assert "text 7 2" in {r["chunk_id"]: r["rendered"] for r in serve.read_context(store, anchors).collect()}[(7 << 20) + 2]
    assert store.points_of("none").count() == 0


def test_a_document_that_moves_to_another_slot_leaves_no_rows(spark, store):
    load(store, spark, range(10))
    moved = points(spark, [77]).withColumn("book", F.lit("d3"))
    store.replace(spark.createDataFrame([("d3", 77)], "book string, slot bigint"), moved)
    assert {r["id"] >> 20 for r in store.points().filter("book = 'd3'").collect()} == {77}


def test_a_job_that_fails_keeps_the_old_rows(spark, store):
    load(store, spark, range(5))
    before = sorted(map(tuple, store.manifest().collect()))
    bad = points(spark, [2, 9]).withColumn("text", F.when(F.col("book") == "d9", F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        store.replace(spark.createDataFrame([("d2", 2), ("d9", 9)], "book string, slot bigint"), bad, rows=10)
    again = S.Store(spark, store.path)
    assert sorted(map(tuple, again.manifest().collect())) == before and again.count() == 25
    again.write_manifest(manifest(spark, [9]))
    assert again.manifest().count() == 6


def test_shards_are_kept_emptied_and_forgotten(spark, store):
    load(store, spark, range(12))
    assert S.Store(spark, store.path, shards=99).shards == 4
    keys = spark.createDataFrame([(f"d{s}",) for s in range(12)], "key string")
    store.remove(keys.limit(0))
    assert store.count() == 60
    store.remove(keys.filter("key <> 'd5'"))
    assert {r["book"] for r in store.points().collect()} == {"d5"} and [r["key"] for r in store.manifest().collect()] == ["d5"]
    store.remove(keys)
    assert store.count() == 0 and store.manifest().isEmpty()
    load(store, spark, [3])
    assert store.count() == 5 and store.manifest().count() == 1
    store.drop()
    assert store.count() == 0 and store.manifest().isEmpty() and S.Store(spark, store.path, shards=7).shards == 7


def test_only_touched_partitions_are_rewritten(spark, store, tmp_path):
    load(store, spark, range(60))
    before = {p.parent.name: p.name for p in files(store, tmp_path)}
    load(store, spark, [8])
    after = {p.parent.name: p.name for p in files(store, tmp_path)}
    assert sum(before[x] != after[x] for x in before) == 1


def test_a_copy_is_safe_to_repeat(spark, store, tmp_path):
    load(store, spark, range(9))
    other = S.Store(spark, str(tmp_path / "other"), shards=3)
    assert store.copy_to(other) == store.copy_to(other) == (45, 9)
    assert sorted(map(str, other.points().collect())) == sorted(map(str, store.points().collect()))
    assert S.Store(spark, str(tmp_path / "none")).copy_to(other) == (0, 0) and other.count() == 45
