"""DataFrame helpers that stay even when one key holds most of the rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.config import DEFAULTS


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a session inside one JVM may go without."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        alone = context.master == "local" or context.master.startswith("local[")
        if not folder and not alone:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return context.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: for wide rows, of which few columns are read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prefix_sum(
    df: DataFrame, order: Sequence[str], value: Column | None = None,
    group: Sequence[str] = (), name: str = "n",
) -> DataFrame:
    """Adds the running sum of ``value`` (default 1) along ``order`` per ``group``.

    A plain window would bring a group into one task. Here rows are spread by
    range over (group, order), summed inside each range, and shifted by the
    total of the ranges before, so a group of any size is split. ``order`` must
    be unique within a group. Pass narrow rows: they are written out once so
    that both uses of the ranges see the same borders.
    """
    group = list(group)
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = durable(
        df.withColumn("_value", (F.lit(1) if value is None else value).cast("bigint"))
        .repartitionByRange(ranges, *group, *order)
        .withColumn("_range", F.spark_partition_id())
    )
    inside = Window.partitionBy("_range", *group).orderBy(*order)
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range and group: at most the ranges plus the number of groups
    shifts = rows.groupBy("_range", *group).agg(F.sum("_value").alias("_sum")).select(
        "_range", *group, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift")
    )
    return (
        rows.withColumn("_local", F.sum("_value").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(shifts, ["_range", *group])
        .withColumn(name, F.col("_local") + F.col("_shift"))
        .drop("_range", "_value", "_local", "_shift")
    )


def small(df: DataFrame, rows: int = DEFAULTS.broadcast_rows, size: int = DEFAULTS.broadcast_bytes) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and ``size`` bytes.

    The count stops after ``rows + 1`` rows; texts and arrays count with their
    real length. A larger side is left to a shuffle join.
    """
    wide = [n for n, t in df.dtypes if not t.startswith(("int", "bigint", "double", "float", "boolean"))]
    width = sum((F.coalesce(F.length(F.to_json(F.struct(F.col(f"`{n}`")))), F.lit(0)) for n in wide), F.lit(8 * len(df.columns)))
    found = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(width.cast("bigint"))).first()
    return F.broadcast(df) if found[0] <= rows and (found[1] or 0) <= size else df
