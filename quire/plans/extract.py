"""From registered files to page-marked text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.config import DEFAULTS, Settings
from quire.functions.frames import durable, small
from quire.operators import maintenance as M
from quire.operators import registry as G
from quire.sources import pages as P
from quire.sources.files import content_hashes, located

c = F.col
WHOLE = 1 << 30  # a document that is a whole file ends at its last page


def extract(
    registry: DataFrame, texts: DataFrame, root: str, engine: str | P.Engine = "pymupdf",
    keys: Sequence[str] | None = None, force: bool = False, settings: Settings = DEFAULTS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``key, text`` of the documents read anew, the report, and the registry with file hashes.

    A document is read if it has no text, if its file changed since, or by
    force. Work goes by file, hashed by blocks and opened for all of its articles
    together; only pages that one of them asks for are read. A file with a page
    that fails gives no text at all, and its documents are tried again by the
    next run. The report has
    ``key, status, detail``: cached, adopted, no pdf, MISSING, NO TEXT LAYER,
    failed or extracted.
    """
    wanted = M.only(registry, keys)
    listed = located(wanted.select(c("pdf").alias("path")), root)
    hashes = durable(content_hashes(listed).select(c("path").alias("pdf"), "file_hash"))
    have = texts.select("key").distinct().withColumn("has_text", F.lit(True))
    rows = durable(
        wanted.join(hashes, "pdf", "left").join(have, "key", "left")
        .withColumn("has_pdf", c("file_hash").isNotNull()).withColumn("has_text", F.coalesce("has_text", F.lit(False))))
    state = G.extract_status(rows.withColumn("needs_ocr", F.lit(False)), force)
    pending = durable(rows.join(state.filter("status = 'extracted'").select("key"), "key", "left_semi").select(
        "key", "pdf", "title", "pages", "page_offset",
        F.coalesce(c("pages.lo"), F.lit(1)).alias("lo"), F.coalesce(c("pages.hi"), F.lit(WHOLE)).alias("hi")))
    asked = pending.groupBy(c("pdf").alias("path")).agg(F.collect_set(F.struct("lo", "hi")).alias("wanted"))
    read = P.read_pages(asked, root, engine)  # all pages of a file, or its error
    good = read.filter("error is null")
    whole = pending.filter(c("hi") == WHOLE).select("key", "pdf")
    parts = pending.filter(c("hi") < WHOLE).select("key", "pdf", "page_offset", "lo", "hi")
    own = good.join(small(whole), "pdf").select("key", "page", "text").unionByName(
        G.pages_in_span(parts, good).select("key", "page", "text"))
    layer = durable(G.text_layer(own, settings))
    usable = pending.join(layer.filter("not needs_ocr").select("key"), "key", "left_semi")
    name = engine if isinstance(engine, str) else "engine"
    fresh = P.assemble(usable, own.join(usable.select("key"), "key", "left_semi"), name)

    failed = read.filter("error is not null").select("pdf", "error")
    report = (
        rows.select("key", "pdf").join(state, "key").join(layer, "key", "left").join(failed, "pdf", "left")
        .select("key", F.when(c("status") != "extracted", c("status")).when(c("error").isNotNull(), "failed")
                .when(F.coalesce("needs_ocr", F.lit(True)), "NO TEXT LAYER").otherwise("extracted").alias("status"),
                F.coalesce("error", F.concat(c("chars").cast("string"), F.lit(" characters"))).alias("detail"))
    )
    current = report.filter(c("status").isin("extracted", "adopted")).select("key").join(
        rows.select("key", "file_hash"), "key")
    after = registry.join(current, "key", "left").withColumn("pdf_hash", F.coalesce("file_hash", "pdf_hash")).select(*registry.columns)
    return fresh, report, after
