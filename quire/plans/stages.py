"""Cleaning and chunking as stages of their own, each with a stored table.

A stage keeps one row per document: what it made, and a stamp of all that this
depends on. A run compares stamps first and works on documents whose stamp
differs, so a new title cuts a document into passages again without cleaning it
again, and only the shards of such documents are rewritten.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.config import DEFAULTS, Settings
from quire.functions import text as T
from quire.functions.expr import remembered
from quire.functions.frames import small, stored
from quire.operators import chunking as K
from quire.operators import maintenance as M
from quire.operators.cleaning import clean, clean_signature
from quire.operators.pages import resolve_matter
from quire.sources.store import Store, overwrite_shards, read_table

c = F.col
PASSAGE = (
    "struct<chapter:int,section:string,section_title:string,page_start:int,page_end:int,n_tokens:int,text:string,embed_text:string>"
)
SCHEMAS = {
    "clean": "key string, slot bigint, stamp string, clean_text string, shard int",
    "chunk": f"key string, slot bigint, stamp string, book_title string, kind string, source string, chunks array<{PASSAGE}>, shard int",
}


def clean_stamp(settings: Settings = DEFAULTS) -> Column:
    """What the cleaned text of a document depends on; whether its matter is guessed is part of it."""
    own = clean_signature(T.content_hash(c("text")), c("skip_pages"), c("body_end_page"), settings)
    return F.md5(F.concat_ws("|", own, F.to_json("auto")))


def chunk_stamp(clean: Column, settings: Settings = DEFAULTS) -> Column:
    """What the passages depend on: the cleaned text, and all that is written into them."""
    part = lambda x: F.coalesce(c(x).cast("string"), F.lit("-"))
    return F.md5(F.concat_ws("|", clean, *(part(x) for x in ("title", "slot", "kind", "source")), F.lit(repr(settings))))


@remembered
def _matter(redetect: bool) -> Column:
    return resolve_matter(c("auto"), c("skip_pages"), c("body_end_page"), c("text"), redetect)


def resolve(documents: DataFrame, redetect: bool = False) -> DataFrame:
    """Documents with front and back matter filled in where it may be guessed."""
    return (
        documents.withColumn("_matter", _matter(redetect))
        .withColumn("skip_pages", c("_matter.skip_pages"))
        .withColumn("body_end_page", c("_matter.body_end_page"))
        .drop("_matter")
    )


class Stages:
    """The stage tables of an index, beside its points and split like them."""

    def __init__(self, store: Store, settings: Settings = DEFAULTS, count: Callable[[Column], Column] = T.token_count):
        self.store, self.settings, self.count = store, settings, count

    def path(self, stage: str) -> str:
        return f"{self.store.path}/stage_{stage}"

    def table(self, stage: str) -> DataFrame:
        return read_table(self.store.spark, self.path(stage), SCHEMAS[stage]).where("key is not null")

    def run(self, documents: DataFrame, force: bool = False) -> DataFrame:
        """Brings both tables in step with ``documents`` (registry rows with ``text``).

        Gives ``key, clean, chunk``: which stage ran for which document. Texts
        are hashed in one pass and read again only where they changed.
        """
        stamps = documents.select("key", "slot", "title", "kind", "source", clean_stamp(self.settings).alias("clean"))
        now = stored(stamps.withColumn("chunk", chunk_stamp(c("clean"), self.settings)).select("key", "slot", "clean", "chunk"), "stamps")
        have = {s: self.table(s).select("key", "stamp") for s in SCHEMAS}
        state = M.stale_stages(now, have) if not force else now.select("key", F.lit(True).alias("clean"), F.lit(True).alias("chunk"))
        state = stored(state, "state")

        def due(stage: str) -> DataFrame:
            return small(state.where(stage).join(now, "key").select("key", now[stage].alias("stamp")))

        todo = documents.join(due("clean"), "key")
        self._put("clean", clean(resolve(todo), self.settings).select("key", "slot", "stamp", "clean_text"), state, now)
        texts = self.table("clean").select("key", "clean_text")
        todo = documents.drop("text").join(due("chunk"), "key").join(texts, "key")
        made = K.chunk_arrays(todo, self.count, self.settings).withColumnRenamed("book", "key")
        made = made.join(due("chunk"), "key").select("key", "slot", "stamp", "book_title", "kind", "source", "chunks")
        self._put("chunk", made, state, now)
        return state

    def _put(self, stage: str, fresh: DataFrame, state: DataFrame, now: DataFrame) -> None:
        """Exchanges the rows of documents whose stage ran; their shards, old and new, are rewritten."""
        ran = state.where(stage).select("key")
        before = self.table(stage)
        slots = now.join(ran, "key").select("slot").unionByName(before.join(small(ran), "key", "left_semi").select("slot"))
        touched = [r[0] for r in slots.select(self.store.shard_of(c("slot"))).distinct().collect()]  # one per shard at most
        if touched:
            self.store._keep_layout()
            rest = before.where(c("shard").isin(touched)).join(small(ran), "key", "left_anti")
            own = self.store.shard_of(c("slot"))
            held = rest.select("shard").unionByName(now.join(ran, "key").select(own.alias("shard")))  # each gives a row
            overwrite_shards(self.path(stage), rest.unionByName(fresh.withColumn("shard", own)), touched, "slot", held=held)

    def passages(self, keys: DataFrame) -> DataFrame:
        """The passages of the documents in ``keys``, one row each, as the index takes them."""
        rows = self.table("chunk").join(small(keys.select("key").distinct()), "key", "left_semi")
        return K.explode_chunks(rows.withColumnRenamed("key", "book"), self.settings)

    def stamps(self, keys: Sequence[str] | None = None) -> DataFrame:
        """``key, input_sig`` of the documents that have been cut into passages."""
        return M.only(self.table("chunk"), keys).select("key", c("stamp").alias("input_sig"))

    def remove(self, keys: DataFrame) -> None:
        """Takes documents (column ``key``) out of both tables."""
        for stage in SCHEMAS:
            gone = stored(self.table(stage).join(small(keys.select("key").distinct()), "key", "left_semi").select("key", "shard"), "gone")
            touched = [r[0] for r in gone.select("shard").distinct().collect()]
            if touched:
                rest = self.table(stage).where(c("shard").isin(touched)).join(small(gone.select("key")), "key", "left_anti")
                overwrite_shards(self.path(stage), stored(rest, "rest"), touched, "slot")

    def drop(self) -> None:
        for stage, schema in SCHEMAS.items():
            empty = self.store.spark.createDataFrame([], schema)
            empty.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("shard").parquet(self.path(stage))
