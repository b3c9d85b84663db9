"""Document tables laid out as extracted, page-marked text.

The ``documents`` table holds plain paragraphs. To give the text operators the
material they exist for, every document is laid out in full as a scanned book
would be: hard-wrapped lines with split words, headings, pages with markers,
running headers, folios, download banners and captions, a contents page and an
index. The layout is a projection; no text is dropped or shortened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.expr import bind, remembered
from quire.operators.chunking import chunk_documents
from quire.operators.cleaning import clean
from quire.operators.pages import resolve_matter
from quire.operators.sections import ROMANS

WRAP = 9
PAGE_ROWS = 12
INDEX_ROWS = 10
CONTENTS_FROM = 6
INDEX_FROM = 8
SPLITTABLE = "^[A-Za-z]{8,}$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` with at least one partition per core.

    Text work is heavy per byte. A table of many files already has the splits
    and is left alone; a small one, often a single row group, would otherwise
    run in one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2, key) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def _word(words: Column, n: Column) -> Column:
    return F.coalesce(F.get(words, n - 1), F.lit(""))


def _wrapped(words: Column) -> Column:
    """Lines of nine words; long words at a line end are split with a hyphen."""
    lines = F.ceil(F.size(words) / WRAP).cast("int")

    def line(k: Column) -> Column:
        text = F.array_join(F.slice(words, k * WRAP + 1, F.lit(WRAP)), " ")
        tail = _word(words, k * WRAP + WRAP)
        carried = _word(words, k * WRAP)
        return F.concat(
            F.when((k > 0) & carried.rlike(SPLITTABLE), F.concat(F.substr(carried, F.lit(5)), F.lit(" ")))
            .otherwise(""),
            F.when(
                (k < lines - 1) & tail.rlike(SPLITTABLE),
                F.concat(F.left(text, F.length(text) - F.length(tail) + 4), F.lit("-")),
            ).otherwise(text),
        )

    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(lines - 1, F.lit(0))), line)
    )


def _heading(words: Column, i: Column, kind: Column) -> Column:
    title = F.concat(F.lit("Study "), F.array_join(F.slice(words, 1, 2), " "))
    block = F.floor(i / 5).cast("int")
    roman = F.get(F.array(*map(F.lit, ROMANS)), F.floor(i / 10).cast("int"))
    # past the numerals that headings are recognised by, all headings are lettered
    paper = F.when((block % 2 == 0) & roman.isNotNull(), F.concat(roman, F.lit(". "))).otherwise("A. ")
    book = F.concat(F.lit("1."), (block + 1).cast("string"), F.lit(" "))
    return F.concat(F.when(kind == "article", paper).otherwise(book), title)


def _chunks_of(items: Column, n: int) -> Column:
    def split(xs: Column) -> Column:
        last = F.greatest(F.ceil(F.size(xs) / n).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda p: F.slice(xs, p * n + 1, F.lit(n)))

    return bind(items, lambda xs: F.filter(split(xs), lambda page: F.size(page) > 0))


def _body_page(b: Column, p: Column, source: Column) -> Column:
    compound = F.concat(
        F.regexp_extract(F.get(b, F.lit(2)), "([A-Za-z]{4}-)$", 1),
        F.regexp_extract(F.get(b, F.lit(3)), "^([a-z]+)", 1),
    )
    shown = F.when(F.coalesce(F.get(b, F.lit(2)), F.lit("")).endswith("-"), compound).otherwise("nothing")
    none = F.array().cast("array<string>")
    return F.concat(
        F.slice(b, 1, 5),
        F.when(
            F.size(b) > 6,
            F.array(
                F.concat(F.lit("Figure "), p.cast("string"), F.lit(".1 shows "), shown),
                F.concat(F.lit("as measured for "), source),
                F.lit(""),
            ),
        ).otherwise(none),
        F.slice(b, 6, PAGE_ROWS),
    )


def _page(lines: Column, p: Column, source: Column) -> Column:
    n = p.cast("string")
    none = F.array().cast("array<string>")
    return F.array_join(
        F.concat(
            F.array(
                F.concat(F.lit("[PAGE "), n, F.lit("]")),
                F.concat(F.lit("COLLECTED REPORTS OF "), F.upper(source)),
            ),
            F.when(
                p % 2 == 0,
                F.array(F.concat(F.lit("Downloaded from https://onlinelibrary.wiley.com, page "), n)),
            ).otherwise(none),
            lines,
            F.array(n),
        ),
        "\n",
    )


@remembered
def _layout() -> tuple[Column, ...]:
    """Body pages, contents page and index pages, then the text made of them."""
    c = F.col
    none = F.array().cast("array<string>")
    body = F.flatten(
        F.transform(
            c("_pars"),
            lambda ws, i: F.concat(
                F.when(i % 5 == 4, F.array(_heading(ws, i, c("kind")))).otherwise(none),
                _wrapped(ws),
                F.array(F.lit("")),
            ),
        )
    )
    contents = F.concat(
        F.array(F.lit("CONTENTS")),
        F.transform(
            c("_pars"),
            lambda ws, i: F.concat(
                F.array_join(F.slice(ws, 1, 2), " "), F.lit(" "), (i + 2).cast("string")
            ),
        ),
    )
    entries = F.transform(
        c("_pars"),
        lambda ws, i: F.concat(
            _word(ws, F.lit(1)), F.lit(", "), (i + 2).cast("string"), F.lit(", "), (i + 5).cast("string")
        ),
    )
    no_pages = F.array().cast("array<array<string>>")
    opening = F.when(F.size("_pars") >= CONTENTS_FROM, F.array(contents)).otherwise(no_pages)
    index = F.when(F.size("_pars") >= INDEX_FROM, _chunks_of(entries, INDEX_ROWS)).otherwise(no_pages)
    pages = F.concat(
        c("_opening"),
        F.transform(c("_body"), lambda b, k: _body_page(b, k + 1 + F.size("_opening"), c("source"))),
        c("_index"),
    )
    laid = F.array_join(F.transform(pages, lambda ls, k: _page(ls, k + 1, c("source"))), "\n")
    glyphs = F.replace(
        F.replace(laid, F.lit("fi"), F.lit(chr(0xFB01))),
        F.lit("tion "), F.lit("tion" + chr(0x2019) + " "),
    )
    header = F.concat(
        F.lit("# SOURCE: "), c("source"), F.lit("\n# TITLE: "), c("title"),
        F.lit("\n# PAGES: pdf index\n\n"),
    )
    return _chunks_of(body, PAGE_ROWS), opening, index, F.concat(header, glyphs)


def registry(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Registry rows of the documents table: ``key, title, kind, source, slot``."""
    c = F.col
    return documents(spark, sf_dir).select(
        c("doc_id").alias("slot"),
        F.concat(F.lit("doc_"), c("doc_id").cast("string")).alias("key"),
        F.array_join(F.slice(F.split(c("text"), "[ \n]+", 4), 1, 3), " ").alias("title"),
        F.when(c("lang") == "fr", "article").when(c("lang") == "de", "issue").otherwise("book").alias("kind"),
        "source",
        *extra,
    )


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, title, kind, source, slot, auto, skip_pages, body_end_page, text``."""
    c = F.col
    body, opening, index, text = _layout()
    docs = registry(spark, sf_dir, "text").withColumn(
        "_pars",
        F.transform(F.split(c("text"), "\n"), lambda p: F.filter(F.split(p, " "), lambda w: w != "")),
    )
    return docs.select(
        "*", body.alias("_body"), opening.alias("_opening"), index.alias("_index")
    ).select(
        "key", "title", "kind", "source", "slot",
        F.when(c("kind") == "article", F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("skip_pages"), F.lit("body_end_page")))
        .alias("auto"),
        F.array().cast("array<struct<lo:int,hi:int>>").alias("skip_pages"),
        F.lit(None).cast("int").alias("body_end_page"),
        text.alias("text"),
    )


@remembered
def _matter() -> Column:
    c = F.col
    return resolve_matter(c("auto"), c("skip_pages"), c("body_end_page"), c("text"))


def resolved(docs: DataFrame) -> DataFrame:
    """Extracted documents with front and back matter detected."""
    return (
        docs.withColumn("_matter", _matter())
        .withColumn("skip_pages", F.col("_matter.skip_pages"))
        .withColumn("body_end_page", F.col("_matter.body_end_page"))
        .drop("_matter")
    )


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(resolved(extracted(spark, sf_dir)))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(cleaned(spark, sf_dir))


