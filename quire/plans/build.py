"""From extracted texts to an up-to-date index."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.config import DEFAULTS, Settings
from quire.functions import text as T
from quire.functions.encoding import Encoder, embed
from quire.functions.frames import durable, small
from quire.operators import maintenance as M
from quire.operators.chunking import chunk_documents
from quire.operators.cleaning import clean
from quire.plans.stages import Stages, resolve
from quire.sources.store import Store


def passages(
    documents: DataFrame, redetect: bool = False,
    count: Callable[[Column], Column] = T.token_count, settings: Settings = DEFAULTS,
) -> DataFrame:
    """Chunks of registry rows that carry their extracted ``text``: one map-only plan."""
    return chunk_documents(clean(resolve(documents, redetect), settings), count, settings)


def ingest(
    chunks: DataFrame, registry: DataFrame, store: Store, keys: Sequence[str] | None = None,
    force: bool = False, recreate: bool = False, limit: int | None = None,
    encoder: Encoder | None = None,
) -> DataFrame:
    """Bring the store in step with ``registry`` and its ``chunks``; gives the documents loaded.

    Only documents whose chunks differ from what the manifest signs for are
    embedded. Their old points leave in the same write that brings the new ones,
    and a document without chunks just loses its points. The manifest follows
    after, so an interrupted run is repeated, not skipped.
    """
    if recreate:
        store.drop()
    registry, chunks = M.only(registry, keys), M.only(chunks, keys, "book")
    if "input_sig" not in registry.columns:
        registry = registry.withColumn("input_sig", F.lit(None).cast("string"))
    if limit:
        chunks = M.first_per_group(chunks, limit)
        registry = registry.withColumn("input_sig", F.lit(None).cast("string"))
    signed = M.document_signatures(registry, M.index_signature(chunks, limit=limit))
    # narrow: one row per changed document
    todo = durable(M.stale(signed, store.manifest(), force or recreate))
    if not todo.isEmpty():
        books = todo.select(F.col("key").alias("book"), "slot")
        fresh = embed(chunks.join(small(books.select("book")), "book", "left_semi"), encoder=encoder)
        gone = todo.filter("chunks = 0").select(F.col("key").alias("book"), "slot")
        store.replace(books, fresh, gone=gone, rows=todo.agg(F.sum("chunks")).first()[0])
        store.write_manifest(todo)
    return todo


def build(
    documents: DataFrame, store: Store, settings: Settings = DEFAULTS,
    keys: Sequence[str] | None = None, force: bool = False, recreate: bool = False,
    limit: int | None = None, encoder: Encoder | None = None, load: bool = True,
) -> DataFrame:
    """Clean, chunk and ingest registry rows with text; gives the documents loaded.

    Each stage works on the documents whose stamp differs from the one stored
    with its output: cleaning, cutting, loading. ``load=False`` stops before the
    index, and ``force`` redoes every stage. The result has the manifest rows of
    the documents loaded, none without ``load``.
    """
    documents = M.only(documents, keys)
    stages = Stages(store, settings)
    if recreate:
        store.drop()
        stages.drop()
    stages.run(documents, force)
    if not load:
        return store.manifest().limit(0)
    stamped = stages.stamps().join(documents.select("key"), "key", "left_semi")
    if not (force or limit):
        known = store.manifest().select("key", "input_sig")
        stamped = stamped.join(known, ["key", "input_sig"], "left_anti")
    changed = durable(stamped)
    registry = documents.join(small(changed), "key").select("slot", "key", "title", "kind", "source", "input_sig")
    loaded = ingest(stages.passages(changed), registry, store, force=force, limit=limit, encoder=encoder)
    same = changed.join(loaded, "key", "left_anti")
    if not limit and not same.isEmpty():
        # other input, same chunks: only the stamp changes
        store.write_manifest(store.manifest().drop("input_sig").join(same, "key"))
    return loaded
