"""From files to registry rows: what is new, how it is made up, what it is called."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import schemas
from quire.config import DEFAULTS, Settings
from quire.functions.frames import durable
from quire.operators import registry as G
from quire.sources import pages as P

c = F.col


def conform(rows: DataFrame, schema: str = schemas.REGISTRY) -> DataFrame:
    """Rows with exactly the columns of a schema, missing ones null."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    return rows.select(*(
        (c(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def documents_of(triaged: DataFrame, structure: DataFrame, registry: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Registry rows for the new files among ``triaged`` from their ``structure``.

    ``structure`` is what :func:`quire.sources.pages.read_structure` gives. Long
    files with many outline entries become one row per article, with a title
    from the largest type of its first page and the offset of its printed pages.
    """
    good = structure.filter("error is null")
    counts = good.select(c("path").alias("pdf"), "page_count")
    toc = good.select(c("path").alias("pdf"), F.explode("toc").alias("t")).select("pdf", "t.*")
    heads = good.select(c("path").alias("pdf"), F.explode("heads").alias("h")).select("pdf", "h.*")
    titles = G.page_titles(heads.select("pdf", "page", F.explode("spans").alias("s")).select("pdf", "page", "s.*"), settings)
    outline = G.top_outline(toc)
    kinds = G.issues(outline, counts, settings)
    split = kinds.filter("is_issue").select("pdf")
    spans = durable(G.article_spans(outline.join(split, "pdf", "left_semi"), counts))
    offsets = G.page_offsets(spans, heads.select("pdf", "page", "text"), settings)
    articles = (
        spans.join(titles.select("pdf", c("page").alias("lo"), c("title").alias("_title")), ["pdf", "lo"], "left")
        .join(offsets, "pdf", "left")
        .select(c("pdf").alias("path"), "nth", c("title").alias("bookmark"), F.coalesce("_title", F.lit("")).alias("title"), "lo", "hi", "page_offset")
    )
    first = titles.filter("page = 1").select("pdf", "title")
    whole = kinds.join(first, "pdf", "left").select(c("pdf").alias("path"), "page_count", "is_issue", "title")
    return G.new_documents(triaged, whole, articles, registry, settings)


def register(
    files: DataFrame, root: str, registry: DataFrame, engine: str | P.Engine = "pymupdf", settings: Settings = DEFAULTS,
) -> tuple[DataFrame, DataFrame]:
    """The registry after a scan, and ``path, status, documents, error`` of the files seen.

    Files known by path are left alone, moved ones are followed by name, volume
    indexes passed over; only new files are opened, each once. A file that
    cannot be read is reported and tried again by the next scan. Articles that
    turn out not to be papers are pruned.
    """
    registry = conform(registry)
    triaged = durable(G.triage(G.distinct_files(files), registry))
    structure = durable(P.read_structure(triaged.filter("status = 'new'"), root, engine))
    fresh = durable(conform(documents_of(triaged, structure, registry, settings)))
    fresh = fresh.withColumn("text", F.concat("key", F.lit(".txt")))
    found = fresh.groupBy(c("pdf").alias("path")).agg(F.count(F.lit(1)).alias("documents"))
    report = (
        triaged.join(structure.select("path", "error"), "path", "left").join(found, "path", "left")
        .select("path", F.when(c("error").isNotNull(), "failed").otherwise(c("status")).alias("status"),
                F.coalesce("documents", F.lit(0).cast("bigint")).alias("documents"), "error")
    )
    return G.prune(G.follow_moves(registry, triaged).unionByName(fresh), settings), report
