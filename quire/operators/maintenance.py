"""Keeping the index in step with the corpus: signatures, upserts, removals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.config import DEFAULTS


def only(df: DataFrame, keys: Sequence[str] | None, column: str = "key") -> DataFrame:
    """Restriction to a key list; no list means everything."""
    return df.filter(F.col(column).isin(*keys)) if keys else df


def index_signature(chunks: DataFrame, stride: int = DEFAULTS.id_stride, limit: int | None = None) -> DataFrame:
    """``book, slot, chunks, sig``: identity of each document's chunk rows.

    Row hashes are summed as exact decimals, which combines before the shuffle
    and needs no order: ids take part in each row's hash. A limited ingest signs
    differently, so that a full one is not skipped after it.
    """
    row = F.md5(F.concat_ws("\x1f", F.col("id").cast("string"), F.col("embed_text")))

    def half(start: int) -> Column:
        part = F.conv(F.substring(row, start, 15), 16, 10).cast("decimal(20,0)")
        return F.sum(part).cast("string")

    suffix = "" if limit is None else f":first{limit}"
    return (
        chunks.groupBy("book")
        .agg(
            F.floor(F.min("id") / stride).alias("slot"),
            F.count(F.lit(1)).alias("chunks"),
            F.concat_ws("-", half(1), half(16)).alias("_sum"),
        )
        .select(
            "book", "slot", "chunks",
            F.concat(F.md5("_sum"), F.lit(":"), F.col("slot").cast("string"), F.lit(suffix)).alias("sig"),
        )
    )


def document_signatures(registry: DataFrame, signatures: DataFrame) -> DataFrame:
    """Manifest rows the documents should have; one without chunks signs as empty."""
    signed = signatures.select(F.col("book").alias("key"), "sig", "chunks")
    return registry.join(signed, "key", "left").select(
        "slot", "key", F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("sig", F.concat(F.lit("empty:"), F.col("slot").cast("string"))).alias("sig"),
        F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks"),
        F.coalesce("kind", F.lit("book")).alias("kind"), F.coalesce("source", F.lit("")).alias("source"),
        "input_sig",
    )


def stale(current: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Documents whose signature is not the one the manifest holds."""
    if force:
        return current
    return current.join(manifest.select("key", "sig"), ["key", "sig"], "left_anti").select(*current.columns)


def stale_stages(now: DataFrame, stored: dict[str, DataFrame]) -> DataFrame:
    """``key`` and, for each stage, whether it has to run: its stamp is not the one stored with its output.

    ``now`` has ``key`` and a stamp per stage under the stage's name; a stamp
    says all that the stage depends on, stages before it included. ``stored``
    has ``key, stamp`` of what each stage has written.
    """
    for name, have in stored.items():
        same = have.select("key", F.col("stamp").alias(name), F.lit(True).alias("_have"))
        now = now.join(same.dropDuplicates(["key", name]), ["key", name], "left").withColumn(f"_{name}", F.col("_have").isNull()).drop("_have")
    return now.select("key", *(F.col(f"_{name}").alias(name) for name in stored))


def first_per_group(df: DataFrame, n: int, group: str = "book", order: str = "id") -> DataFrame:
    """The first ``n`` rows of each group; every task cuts its share before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("_n", rank).filter(F.col("_n") <= n).drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` with rows of equal key replaced by ``new`` ones."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of highest version per key, combined before the shuffle."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(whole, version).alias("_row")).select("_row.*")


def replace_documents(points: DataFrame, fresh: DataFrame) -> DataFrame:
    """Points with every book of ``fresh`` exchanged whole, so none leaves orphans."""
    books = fresh.select("book").distinct()
    return points.join(books, "book", "left_anti").unionByName(fresh)


def remove_documents(df: DataFrame, keys: DataFrame, column: str = "book") -> DataFrame:
    """Rows of other documents than those in ``keys`` (column ``key``)."""
    return df.join(keys.select(F.col("key").alias(column)).distinct(), column, "left_anti")


def purgeable(registry: DataFrame, keys: DataFrame) -> DataFrame:
    """Files of removed documents that no remaining document still needs."""
    gone = registry.join(keys.select("key").distinct(), "key", "left_semi")
    rest = registry.join(keys.select("key").distinct(), "key", "left_anti")
    return gone.select("pdf").distinct().join(rest.select("pdf"), "pdf", "left_anti")


def unregistered(files: DataFrame, registry: DataFrame) -> DataFrame:
    return files.join(registry.select(F.col("pdf").alias("path")), "path", "left_anti")


def copy_into(source: DataFrame, target: DataFrame, key: str = "id") -> DataFrame:
    """Target after copying every source row into it by key; repeating changes nothing."""
    return upsert(target, source, [key])
