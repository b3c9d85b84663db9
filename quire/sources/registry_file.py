"""The document registry: a table split by key, with a single JSON object to bring it in and take it out.

The table is Parquet, partitioned by a hash of the key; a save rewrites the
partitions that hold a row that changed. A path that ends in ``.json`` is the
object instead, which passes through the driver and is meant for small
registries that people edit.
"""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire import schemas
from quire.config import DEFAULTS, Settings
from quire.functions.frames import stored
from quire.sources.store import overwrite_shards, read_table

SHARDS = 256  # partitions of a registry table

_DOCUMENT = (
    "pdf string, title string, kind string, source string, slot bigint, text string, pages array<int>, "
    "page_offset int, skip_pages array<array<int>>, body_end_page int, auto array<string>, pdf_hash string, "
    "text_hash string, clean_sig string, chunk_sig string, chunks bigint"
)


def read_settings(path: str) -> Settings:
    """Defaults overlaid with what the registry object, or the one beside the registry table, sets itself."""
    file = Path(path if is_object(path) else f"{path.rstrip('/')}.json")
    given = json.loads(file.read_text(encoding="utf-8")) if file.exists() else {}
    patterns = given.get("banner_patterns")
    return DEFAULTS if patterns is None else replace(DEFAULTS, banner_patterns=tuple(patterns))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry rows of a JSON object whose ``documents`` map holds one entry per key."""

    def span(pair):
        return F.struct(F.get(pair, F.lit(0)).alias("lo"), F.get(pair, F.lit(1)).alias("hi"))

    whole = spark.read.schema(f"documents map<string, struct<{_DOCUMENT.replace(' ', ':').replace(',:', ', ')}>>").json(
        path, multiLine=True
    )
    c = F.col
    return whole.select(F.explode("documents").alias("key", "d")).select("key", "d.*").select(
        "key", "pdf", "title", F.coalesce("kind", F.lit("book")).alias("kind"),
        F.coalesce("source", F.lit("")).alias("source"), "slot",
        F.when(F.size("pages") == 2, span(c("pages"))).alias("pages"), "page_offset",
        F.coalesce(F.transform("skip_pages", span), F.array().cast(f"array<{schemas.RANGE}>")).alias("skip_pages"),
        "body_end_page", F.coalesce("auto", F.array().cast("array<string>")).alias("auto"), "text",
        "pdf_hash", "text_hash", "clean_sig", "chunk_sig", "chunks",
    )


def write_registry_file(registry: DataFrame, path: str) -> None:
    """The registry as one JSON object, row by row; what else the object sets is kept.

    The new file takes the place of the old one when it is complete.
    """
    file = Path(path)
    other = json.loads(file.read_text(encoding="utf-8")) if file.exists() else {}
    other.pop("documents", None)
    pair = lambda r: None if r is None else [r["lo"], r["hi"]]
    with tempfile.NamedTemporaryFile("w", dir=file.parent, encoding="utf-8", delete=False) as out:
        head = json.dumps(other, ensure_ascii=False, indent=2)
        out.write(head[:-1].rstrip() + ("," if other else "") + '\n"documents": {')
        for n, row in enumerate(registry.orderBy("slot").toLocalIterator()):
            entry = {k: v for k, v in row.asDict().items() if k != "key" and (v is not None or k == "body_end_page")}
            if "pages" in entry:
                entry["pages"] = pair(entry["pages"])
            entry["skip_pages"] = [pair(r) for r in entry.get("skip_pages") or []]
            out.write(("," if n else "") + f"\n{json.dumps(row['key'], ensure_ascii=False)}: {json.dumps(entry, ensure_ascii=False)}")
        out.write("\n}\n}\n")
    os.replace(out.name, file)


def is_object(path: str) -> bool:
    return path.endswith(".json")


def open_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry rows of the table or object at ``path``, none if there is none."""
    if not is_object(path):
        return read_table(spark, path, schemas.REGISTRY + ", shard int").where("key is not null").drop("shard")
    return read_registry(spark, path) if Path(path).exists() else spark.createDataFrame([], schemas.REGISTRY)


def save_registry(registry: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Makes the table or object at ``path`` hold ``registry``, which may depend on what it holds now."""
    if is_object(path):
        return write_registry_file(registry, path)
    columns = StructType.fromDDL(schemas.REGISTRY).names
    rows = stored(registry.select(*columns).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")), "registry")
    before = read_table(registry.sparkSession, path, schemas.REGISTRY + ", shard int").where("key is not null")

    def signed(df: DataFrame) -> DataFrame:
        return df.select("shard", F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).alias("row"))

    sums = [signed(x).groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("sum")) for x in (rows, before)]
    changed = sums[0].exceptAll(sums[1]).unionByName(sums[1].exceptAll(sums[0])).select("shard").distinct()
    touched = [r[0] for r in changed.collect()]  # at most one per shard
    if touched:
        overwrite_shards(path, rows.where(F.col("shard").isin(touched)), touched, "key")
    return None


def write_registry(registry: DataFrame, path: str) -> None:
    """One JSON line per document, for other programs to read."""
    registry.write.mode("overwrite").json(path)


def read_registry_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REGISTRY).json(path)
