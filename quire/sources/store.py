"""The index on disk: points and manifest, each one Parquet table partitioned by shard.

A shard is a hash of a document's slot, which is the high part of every id:
replacing a few documents overwrites only their partitions (Spark's dynamic
partition overwrite, which exchanges them when the job commits), and a read by
document or by id names the partitions it needs. Inside a shard rows are sorted
by id, in files of a bounded number of rows.

A dynamic overwrite leaves a partition alone that it writes no row to, so a
shard whose last document went is written with one row without id, which reads
pass over.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schemas
from quire.config import DEFAULTS
from quire.functions.frames import small, stored
from quire.operators import maintenance as M

ROWS_PER_FILE = 250_000
SHARD = ", shard int"


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``, without rows if there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def overwrite_shards(path: str, rows: DataFrame, touched: list[int], order: str, parts: int = 1, held: DataFrame | None = None) -> None:
    """The shards ``touched`` of the table at ``path`` become ``rows``, a file or a few (``parts``) each.

    A task writes the files of its shards one after the other. A touched shard
    without rows gets one whose columns are null; ``held`` (``shard``) says
    which have rows, where that is known without making them.
    """
    marks = rows.sparkSession.createDataFrame([(s,) for s in touched], "shard int")
    nothing = marks.join((rows if held is None else held).select("shard").distinct(), "shard", "left_anti").select(
        *(F.lit(None).cast(t).alias(n) if n != "shard" else F.col("shard") for n, t in rows.dtypes))
    (
        rows.unionByName(nothing).withColumn("_part", F.pmod(F.xxhash64(order), F.lit(parts)) if parts > 1 else F.lit(0))
        .repartition("shard", "_part").sortWithinPartitions("shard", order).drop("_part")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", ROWS_PER_FILE)
        .partitionBy("shard").parquet(path)
    )


class Store:
    """Tables of one collection below ``path``.

    ``shards`` is chosen when the first points are written and then kept with
    them. A few gigabytes per shard keep small changes cheap: 256 do for a
    terabyte, a 100 TB index wants tens of thousands.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = 256):
        self.spark, self.path = spark, path.rstrip("/")
        kept = self._read("layout", "shards int").first()
        self.shards = kept["shards"] if kept else shards

    def _read(self, name: str, schema: str) -> DataFrame:
        return read_table(self.spark, f"{self.path}/{name}", schema)

    def _keep_layout(self) -> None:
        if self._read("layout", "shards int").isEmpty():
            self.spark.createDataFrame([(self.shards,)], "shards int").coalesce(1).write.mode("append").parquet(f"{self.path}/layout")

    def _sharded(self) -> DataFrame:
        return self._read("points", schemas.POINTS + SHARD).where("id is not null")

    def _manifest(self) -> DataFrame:
        return self._read("manifest", schemas.MANIFEST + SHARD).where("slot is not null")

    def points(self, slots: Iterable[int] | None = None) -> DataFrame:
        """All points, or those of the shards that hold the given slots."""
        points = self._sharded()
        if slots is not None:
            points = points.filter(F.col("shard").isin(self._shards(slots)))
        return points.drop("shard")

    def _shards(self, slots: Iterable[int]) -> list[int]:
        """The shards of slots; at most as many as there are."""
        found = self.spark.createDataFrame([(int(s),) for s in set(slots)], "slot bigint")
        return sorted({r[0] for r in found.select(self.shard_of(F.col("slot"))).collect()})

    def points_of(self, book: str) -> DataFrame:
        """Points of one document: its slot is looked up, and only its shard is read."""
        return self.points([r["slot"] for r in self.manifest().filter(F.col("key") == book).select("slot").collect()])

    def points_near(self, ids: DataFrame, column: str = "chunk_id") -> DataFrame:
        """Points of the documents that hold the given ids, from their shards only."""
        slot = F.floor(F.col(column) / DEFAULTS.id_stride)
        shards = [r[0] for r in ids.select(self.shard_of(slot)).distinct().collect()]  # one per shard at most
        return self._sharded().filter(F.col("shard").isin(shards)).drop("shard")

    def manifest(self) -> DataFrame:
        return self._manifest().drop("shard")

    def count(self) -> int:
        return self.points().count()

    def shard_of(self, slot: Column) -> Column:
        return F.pmod(F.xxhash64(slot.cast("bigint")), F.lit(self.shards)).cast("int")

    def _with_shard(self, points: DataFrame) -> DataFrame:
        return points.withColumn("shard", self.shard_of(F.floor(F.col("id") / DEFAULTS.id_stride)))

    def _overwrite(self, name: str, rows: DataFrame, touched: list[int], order: str, parts: int = 1) -> None:
        overwrite_shards(f"{self.path}/{name}", rows, touched, order, parts)

    def replace(
        self, documents: DataFrame, fresh: DataFrame, gone: DataFrame | None = None, rows: int | None = None,
    ) -> None:
        """Exchange every point of ``documents`` (``book, slot``) for ``fresh`` ones.

        ``rows`` says how many fresh ones there are; ``gone``, the documents
        without any, needs no treatment of its own. Only the shards of the
        documents, old and new, are read and rewritten. The old files go when
        the job commits, so a lost executor or a failed job loses nothing.
        """
        books = documents.select("book").distinct()
        slots = documents.select(F.col("slot").alias("slot")).unionByName(
            self.manifest().join(small(books.select(F.col("book").alias("key"))), "key", "left_semi").select("slot"))
        touched = [r[0] for r in slots.select(self.shard_of(F.col("slot"))).distinct().collect()]
        if not touched:
            return
        self._keep_layout()
        rest = self._sharded().filter(F.col("shard").isin(touched)).join(small(books), "book", "left_anti")
        n = (fresh.count() if rows is None else rows) + rest.select("id").count()
        self._overwrite("points", rest.unionByName(self._with_shard(fresh)), touched, "id", -(-n // (len(touched) * ROWS_PER_FILE)))

    def write_manifest(self, rows: DataFrame) -> None:
        """Manifest rows by slot, the last write winning; only their shards are rewritten."""
        self._keep_layout()
        fresh = rows.select(*self.manifest().columns).withColumn("shard", self.shard_of(F.col("slot")))
        touched = [r[0] for r in fresh.select("shard").distinct().collect()]
        if touched:
            before = self._manifest().filter(F.col("shard").isin(touched))
            self._overwrite("manifest", M.upsert(before, fresh, ["slot"]), touched, "slot")

    def remove(self, keys: DataFrame) -> None:
        """Delete the points and manifest rows of documents (column ``key``)."""
        gone = stored(self._manifest().join(small(keys.select("key").distinct()), "key", "left_semi").select("key", "slot", "shard"), "gone")
        touched = [r[0] for r in gone.select("shard").distinct().collect()]
        if not touched:
            return
        books = gone.select(F.col("key").alias("book"), "slot")
        self.replace(books, self.points().limit(0), rows=0)
        rest = self._manifest().filter(F.col("shard").isin(touched))
        self._overwrite("manifest", M.remove_documents(rest, keys, "key"), touched, "slot")

    def drop(self) -> None:
        """Forget everything, for a build from scratch: each table is overwritten by one without rows."""
        for name, schema in (("points", schemas.POINTS + SHARD), ("manifest", schemas.MANIFEST + SHARD), ("layout", "shards int")):
            writer = self.spark.createDataFrame([], schema).write.mode("overwrite").option("partitionOverwriteMode", "static")
            (writer.partitionBy("shard") if "shard int" in schema else writer).parquet(f"{self.path}/{name}")

    def copy_to(self, other: Store) -> tuple[int, int]:
        """Copy all points and manifest rows; safe to repeat. Gives both counts."""
        points, manifest = self.points(), self.manifest()
        n = points.count()
        if n:
            other._keep_layout()
            both = other._with_shard(M.copy_into(points, other.points()))
            other._overwrite("points", both, [], "id", -(-(n + other.count()) // (other.shards * ROWS_PER_FILE)))
        other.write_manifest(manifest)
        return n, manifest.count()
