"""What is in the index: listings, summaries, context windows, renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.config import DEFAULTS, Settings
from quire.functions.frames import small
from quire.operators.retrieval import cite_row

# What callers of the tools are shown.
SEPARATOR = "\n\n---\n\n"
NO_HITS = "No passages matched that query."
NOTHING_UNDER = "Nothing indexed under {source!r}. Call list_books() for the sources."
BAD_KIND = 'kind must be "book" or "article".'
KINDS = ("book", "article")


def tool_limits(k: int, settings: Settings = DEFAULTS) -> tuple[int, int]:
    """``(k, candidates)`` of a tool call: k is held to 1..15, five times as many fetched."""
    k = max(1, min(int(k), settings.tool_k_max))
    return k, max(settings.candidates, 5 * k)


def render_hits(hits: DataFrame, with_ids: bool = True) -> DataFrame:
    """``qid, rendered``: the hits of each query as one text in rank order.

    A query has at most ``k`` hits, so each group is small whatever the corpus.
    """
    tag = F.concat(F.lit("  (chunk_id="), F.col("id").cast("string"), F.lit(")")) if with_ids else F.lit("")
    entry = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] "), cite_row(), tag, F.lit("\n"), F.col("text")
    )
    return (
        hits.select("qid", "rank", entry.alias("entry"))
        .groupBy("qid")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "entry"))).alias("entries"))
        .select(
            "qid",
            F.array_join(F.transform("entries", lambda e: e["entry"]), SEPARATOR).alias("rendered"),
        )
    )


def answer_queries(queries: DataFrame, rendered: DataFrame) -> DataFrame:
    """Every query with its rendering, or the message for an empty result."""
    return queries.join(rendered, "qid", "left").select(
        "qid", F.coalesce("rendered", F.lit(NO_HITS)).alias("rendered")
    )


def context(
    points: DataFrame, anchors: DataFrame, before: int = 1, after: int = 1, settings: Settings = DEFAULTS
) -> DataFrame:
    """Neighbours of each anchor chunk within its book and section.

    The at most seven ids around an anchor are spelled out, which makes this an
    equi-join on id instead of a range join, and one pass over the points: the
    anchor itself is among the rows found for it. Sections compare null-safe:
    the opening of a document has none. Unknown anchors find nothing.
    """
    reach = settings.context_reach
    before, after = (max(0, min(int(n), reach)) for n in (before, after))
    wanted = small(anchors.select("chunk_id").distinct()).withColumn(
        "id", F.explode(F.sequence(F.col("chunk_id") - before, F.col("chunk_id") + after))
    )
    requested = F.col("id") == F.col("chunk_id")
    home = F.max(F.when(requested, F.struct("book", "section"))).over(Window.partitionBy("chunk_id"))
    return (
        points.join(wanted, "id")
        .withColumn("_home", home)
        .filter(
            (F.col("book") == F.col("_home.book")) & F.col("section").eqNullSafe(F.col("_home.section"))
        )
        .drop("_home")
        .withColumn("requested", requested)
    )


def render_context(neighbours: DataFrame, anchors: DataFrame) -> DataFrame:
    """``chunk_id, rendered``; an unknown chunk gets a message."""
    entry = F.concat(
        F.lit("[chunk "), F.col("id").cast("string"), F.lit("]"),
        F.when(F.col("requested"), " <- requested").otherwise(""), F.lit(" "), cite_row(),
        F.lit("\n"), F.col("text"),
    )
    texts = (
        neighbours.select("chunk_id", "id", entry.alias("entry"))
        .groupBy("chunk_id")
        .agg(F.sort_array(F.collect_list(F.struct("id", "entry"))).alias("entries"))
        .select(
            "chunk_id",
            F.array_join(F.transform("entries", lambda e: e["entry"]), SEPARATOR).alias("rendered"),
        )
    )
    missing = F.concat(F.lit("No chunk with id "), F.col("chunk_id").cast("string"), F.lit("."))
    return anchors.select("chunk_id").distinct().join(texts, "chunk_id", "left").select(
        "chunk_id", F.coalesce("rendered", missing).alias("rendered")
    )


# ---- documents --------------------------------------------------------------


def list_documents(manifest: DataFrame, registry: DataFrame) -> DataFrame:
    """``book, title, chunks, kind, source`` of the index; the registry if it is empty."""

    def listed(df: DataFrame) -> DataFrame:
        if "chunks" not in df.columns:
            df = df.withColumn("chunks", F.lit(0))
        return df.select(
            F.col("key").alias("book"),
            F.coalesce("title", F.lit("")).alias("title"),
            F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks"),
            F.coalesce("kind", F.lit("book")).alias("kind"),
            F.coalesce("source", F.lit("")).alias("source"),
        )

    return listed(manifest).unionByName(listed(registry).where(~manifest.exists()))


def catalog_summary(documents: DataFrame) -> DataFrame:
    """``section, name, n``: textbooks with chunks, papers per source, the total."""
    article = F.col("kind") == "article"
    books = documents.filter(~article).select(
        F.lit("textbook").alias("section"), F.col("book").alias("name"), F.col("title"),
        F.col("chunks").cast("bigint").alias("n"),
    )
    papers = (
        documents.filter(article)
        .groupBy(unfiled(F.col("source")).alias("name"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("papers_by_source").alias("section"), "name", F.lit("").alias("title"), "n")
    )
    total = documents.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("total_documents").alias("section"), F.lit("").alias("name"), F.lit("").alias("title"), "n"
    )
    return books.unionByName(papers).unionByName(total)


def unfiled(source: Column, label: str = "(unfiled)") -> Column:
    return F.when(F.coalesce(source, F.lit("")) == "", label).otherwise(source)


def catalog_by_source(documents: DataFrame, source: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Documents filed under a journal or year, the first 80 by title, with totals."""
    found = documents.filter(
        F.contains(F.lower(F.coalesce("source", F.lit(""))), F.lit(source.lower()))
    )
    total = found.agg(F.count(F.lit(1))).scalar()
    top = found.orderBy("title", "book").limit(settings.catalog_cap)
    return top.select(
        "book", "title", F.coalesce("source", F.lit("")).alias("source"), total.alias("papers"),
        F.least(total, F.lit(settings.catalog_cap)).alias("showing"),
    )


def nothing_under(source: str) -> str:
    """What a caller is told if no document is filed under a journal or year."""
    return NOTHING_UNDER.format(source=source)


def status_rollup(registry: DataFrame) -> DataFrame:
    """``source, docs, chunked`` per source and in total."""
    group = unfiled(F.col("source"), "(textbooks)")
    return (
        registry.select(group.alias("source"), (F.coalesce("chunks", F.lit(0)) > 0).alias("built"))
        .rollup("source")
        .agg(
            F.count(F.lit(1)).alias("docs"),
            F.count_if("built").alias("chunked"),
            F.grouping("source").alias("_total"),
        )
        .select(
            F.when(F.col("_total") == 1, "TOTAL").otherwise(F.col("source")).alias("source"),
            "docs", "chunked",
        )
    )


def kind_histogram(documents: DataFrame) -> DataFrame:
    return documents.groupBy(F.coalesce("kind", F.lit("book")).alias("kind")).agg(
        F.count(F.lit(1)).alias("n")
    )


# ---- chat -------------------------------------------------------------------


def history_window(turns: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``conv_id, transcript``: the last messages of each conversation as lines.

    Ranking comes first, so the group limit cuts every conversation to a few
    rows before the shuffle and no group is collected whole.
    """
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return (
        turns.withColumn("_age", F.row_number().over(newest))
        .filter(F.col("_age") <= settings.history_messages)
        .select(
            "conv_id", "turn",
            F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "line"))).alias("lines"))
        .select("conv_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("transcript"))
    )
