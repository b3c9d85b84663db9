"""Chunks as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schemas
from quire.operators.maintenance import first_per_group


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One JSON object per chunk, nulls written out."""
    chunks.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_chunks(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Chunks of a folder, with ``limit`` the first ones of each book."""
    chunks = spark.read.schema(schemas.CHUNKS).json(path)
    return first_per_group(chunks, limit) if limit else chunks


def parse_permissive(lines: DataFrame, column: str = "value") -> DataFrame:
    """``lines`` with the parsed ``record`` or an ``error``; nothing is dropped."""
    record = F.from_json(column, "map<string,string>", {"mode": "PERMISSIVE"})
    return lines.withColumn("record", record).withColumn(
        "error",
        F.when(F.col("record").isNull(), F.concat(F.lit("ValueError: not a JSON object: "), F.col(column))),
    )
