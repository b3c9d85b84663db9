"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a session inside one JVM (``local`` or ``local[n]``) may go without
    the setting; it then uses a temporary folder.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        master = context.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quire-llm-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    Cuts the lineage: what reads the result survives the loss of any executor
    without redoing the work before it.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash_sample(rows: DataFrame, most: int, key: Column, *ties: Column) -> DataFrame:
    """The ``most`` rows of the smallest hash ``key`` (a long), ties in order.

    Rows far above the cut are filtered out before the sort, so what meets in
    one task does not grow with the number of tasks. Pass narrow rows.
    """
    share = min(1.0, (2 * most + 1000) / max(1, rows.count()))
    if share < 1:
        rows = rows.where(key <= int(-(1 << 63) + share * (1 << 64)))
    return rows.orderBy(key, *ties).limit(most)
