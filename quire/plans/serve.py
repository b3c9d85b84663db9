"""Questions asked of a store: search, context, catalog, status, chat turns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.config import DEFAULTS, Settings
from quire.functions.encoding import Encoder
from quire.operators import catalog as C
from quire.operators import maintenance as M
from quire.operators import retrieval as R
from quire.sources.store import Store


def search(store: Store, queries: DataFrame, **options) -> DataFrame:
    """Hits for ``qid, text`` rows; options as in :func:`retrieval.search`."""
    return R.search(_points(store, options.get("book")), queries, **options)


def _points(store: Store, book: str | None) -> DataFrame:
    return store.points_of(book) if book else store.points()


def search_passages(
    store: Store, queries: DataFrame, k: int = DEFAULTS.tool_k, book: str | None = None,
    source: str | None = None, kind: str | None = None, rerank: bool = True,
    encoder: Encoder | None = None, settings: Settings = DEFAULTS,
) -> DataFrame:
    """``qid, rendered``: the tool's answer to each query."""
    if kind and kind not in C.KINDS:
        return queries.select("qid", F.lit(C.BAD_KIND).alias("rendered"))
    k, candidates = C.tool_limits(k, settings)
    hits = R.search(
        _points(store, book), queries, k, candidates, book, rerank, source, kind, encoder, settings=settings
    )
    return C.answer_queries(queries, C.render_hits(hits))


def read_context(store: Store, anchors: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """``chunk_id, rendered`` for rows of ``chunk_id``."""
    return C.render_context(C.context(store.points_near(anchors), anchors, before, after), anchors)


def list_books(store: Store, registry: DataFrame, source: str | None = None) -> DataFrame:
    documents = C.list_documents(store.manifest(), registry)
    return C.catalog_by_source(documents, source) if source else C.catalog_summary(documents)


def status(store: Store, registry: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """Documents per source, files not registered yet, and what the index holds."""
    documents = C.list_documents(store.manifest(), registry)
    return {
        "sources": C.status_rollup(registry),
        "unregistered": M.unregistered(files, registry),
        "indexed": C.kind_histogram(documents),
        "chunks": documents.agg(F.count(F.lit(1)).alias("documents"), F.sum("chunks").alias("chunks")),
    }


def chat_contexts(
    store: Store, turns: DataFrame, questions: DataFrame,
    rewrite: Callable[[Column, Column], Column] | None = None, k: int = DEFAULTS.tool_k, **options,
) -> DataFrame:
    """``conv_id, question, query, context``: what a language model answers from.

    ``rewrite(transcript, question)`` makes a follow-up stand alone; without one,
    for a first question, or on an empty result the question is searched as it is.
    The history keeps the plain question, which is why only it is returned.
    """
    asked = questions.join(C.history_window(turns), "conv_id", "left")
    if rewrite is None:
        query = F.col("question")
    else:
        rewritten = rewrite(F.col("transcript"), F.col("question"))
        query = F.when(
            F.col("transcript").isNotNull() & (F.coalesce(F.trim(rewritten), F.lit("")) != ""), rewritten
        ).otherwise(F.col("question"))
    asked = asked.select("conv_id", "question", query.alias("query"))
    hits = search(store, asked.select(F.col("conv_id").alias("qid"), F.col("query").alias("text")), k=k, **options)
    contexts = C.render_hits(hits, with_ids=False).select(F.col("qid").alias("conv_id"), F.col("rendered").alias("context"))
    return asked.join(contexts, "conv_id", "left")
