"""Packing paragraphs into token-bounded, citable passages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.config import DEFAULTS, Settings
from quire.functions import text as T
from quire.functions.expr import bind, cut, remembered
from quire.operators import sections as S

SENTENCE_GAP = r"(?<=[.!?])" + T.SPACE + "+"


def greedy_spans(sizes: Column, target: int, overlap: int) -> Column:
    """``array<struct<lo, hi>>``: index ranges of consecutive elements per chunk.

    A chunk grows while it stays within ``target``; the next one starts with the
    longest tail of whole elements not above ``overlap``. The fold works on the
    sizes alone; texts are put together afterwards from the ranges. ``seen`` and
    ``base`` are running sums before the current element and before the chunk,
    ``tail`` the elements within reach of the overlap (bounded by it).
    """
    pair = "struct<lo:int,hi:int>"
    mark = "struct<at:int,before:bigint>"
    acc = f"struct<done:array<{pair}>,lo:int,base:bigint,seen:bigint,tail:array<{mark}>>"

    def state(done: Column, lo: Column, base: Column, seen: Column, tail: Column) -> Column:
        return F.struct(
            done.alias("done"), lo.alias("lo"), base.alias("base"),
            seen.alias("seen"), tail.alias("tail"),
        ).cast(acc)

    def step(s: Column, x: Column) -> Column:
        upto = s["seen"] + x["n"]
        full = (x["at"] > 0) & (upto - s["base"] > target)
        tail = F.filter(
            F.concat(s["tail"], F.array(F.struct(x["at"].alias("at"), s["seen"].alias("before")).cast(mark))),
            lambda t: upto - t["before"] <= overlap,
        )
        first = F.get(s["tail"], F.lit(0))
        flushed = state(
            F.concat(
                s["done"],
                F.array(F.struct(s["lo"].alias("lo"), (x["at"] - 1).alias("hi")).cast(pair)),
            ),
            F.coalesce(first["at"], x["at"]),
            F.coalesce(first["before"], s["seen"]),
            upto,
            tail,
        )
        return F.when(full, flushed).otherwise(state(s["done"], s["lo"], s["base"], upto, tail))

    start = F.struct(
        F.array().cast(f"array<{pair}>").alias("done"), F.lit(0).alias("lo"),
        F.lit(0).cast("bigint").alias("base"), F.lit(0).cast("bigint").alias("seen"),
        F.array().cast(f"array<{mark}>").alias("tail"),
    ).cast(acc)
    return bind(
        sizes,
        lambda ns: F.aggregate(
            F.transform(ns, lambda n, i: F.struct(i.alias("at"), n.alias("n"))),
            start,
            step,
            lambda s: F.when(F.size(ns) == 0, s["done"]).otherwise(
                F.concat(
                    s["done"],
                    F.array(F.struct(s["lo"].alias("lo"), (F.size(ns) - 1).alias("hi")).cast(pair)),
                )
            ),
        ),
    )


def split_long(
    text: Column, count: Callable[[Column], Column] = T.token_count, settings: Settings = DEFAULTS
) -> Column:
    """Pieces of an oversized paragraph, cut between sentences, without overlap."""
    return bind(
        F.split(text, SENTENCE_GAP),
        lambda sentences: F.filter(
            F.transform(
                greedy_spans(F.transform(sentences, count), settings.target_tokens, 0),
                lambda r: F.array_join(F.slice(sentences, r["lo"] + 1, r["hi"] - r["lo"] + 1), " "),
            ),
            lambda piece: ~T.is_blank(piece),
        ),
    )


def pack(
    blocks: Column,
    header: Column,
    count: Callable[[Column], Column] = T.token_count,
    settings: Settings = DEFAULTS,
) -> Column:
    """``array<struct<text, page_start, page_end, n_tokens>>`` of one section.

    Oversized paragraphs stand alone and cut the section into runs that are
    packed independently.
    """

    def chunk(text: Column, lo: Column, hi: Column) -> Column:
        return F.struct(
            text.alias("text"),
            lo.alias("page_start"),
            hi.alias("page_end"),
            (count(header) + count(text)).alias("n_tokens"),
        )

    def joined(bs: Column) -> Column:
        numbers = F.flatten(F.transform(bs, lambda b: F.array(b["page_start"], b["page_end"])))
        return bind(
            F.array_join(F.transform(bs, lambda b: b["text"]), "\n\n"),
            lambda text: chunk(text, F.array_min(numbers), F.array_max(numbers)),
        )

    def packed(run: Column) -> Column:
        return F.transform(
            greedy_spans(
                F.transform(run, lambda b: b["n"]), settings.target_tokens, settings.overlap_tokens
            ),
            lambda r: bind(F.slice(run, r["lo"] + 1, r["hi"] - r["lo"] + 1), joined),
        )

    def oversized(b: Column) -> Column:
        return F.transform(
            split_long(b["text"], count, settings),
            lambda piece: chunk(piece, b["page_start"], b["page_end"]),
        )

    sized = F.transform(
        blocks,
        lambda b: F.struct(
            b["text"].alias("text"), b["page_start"].alias("page_start"),
            b["page_end"].alias("page_end"), count(b["text"]).alias("n"),
        ),
    )
    return bind(
        sized,
        lambda bs: F.flatten(
            F.transform(
                cut(bs, lambda b: b["n"] > settings.max_tokens),
                lambda g: F.when(g["head"].isNull(), bind(g["body"], packed)).otherwise(
                    F.concat(oversized(g["head"]), bind(g["body"], packed))
                ),
            )
        ),
    )


def section_label(section: Column, title: Column) -> Column:
    return F.when(
        F.coalesce(section, F.lit("")) != "", F.concat(F.lit("Section "), section, F.lit(" "), title)
    ).otherwise(title)


def provenance(title: Column, source: Column, section: Column, section_title: Column) -> Column:
    """Header embedded in front of a passage."""
    parts = F.concat_ws(
        " | ", title, F.when(source != "", source), section_label(section, section_title)
    )
    return F.concat(F.lit("["), parts, F.lit("]"))


@remembered
def _document_chunks(count: Callable[[Column], Column], settings: Settings) -> tuple[Column, Column]:
    """Sections of ``clean_text``, and the numbered passages of ``_sections``."""
    c = F.col

    def of_section(sec: Column) -> Column:
        def with_header(header: Column) -> Column:
            return F.transform(
                F.filter(
                    pack(sec["blocks"], header, count, settings),
                    lambda ch: ch["n_tokens"] >= settings.min_tokens,
                ),
                lambda ch: F.struct(
                    sec["chapter"].alias("chapter"),
                    sec["section"].alias("section"),
                    sec["title"].alias("section_title"),
                    ch["page_start"].alias("page_start"),
                    ch["page_end"].alias("page_end"),
                    ch["n_tokens"].alias("n_tokens"),
                    ch["text"].alias("text"),
                    F.concat(header, F.lit("\n"), ch["text"]).alias("embed_text"),
                ),
            )

        return bind(provenance(c("book_title"), c("source"), sec["section"], sec["title"]), with_header)

    chunks = bind(
        F.flatten(F.transform(c("_sections"), of_section)),
        lambda all_chunks: F.when(
            F.size(all_chunks) > settings.id_stride,
            F.raise_error(F.concat(c("book"), F.lit(": more chunks than its id block holds"))),
        ).otherwise(all_chunks),
    )
    return S.parse_sections(c("clean_text"), c("kind"), settings), chunks


def _sectioned(docs: DataFrame, count: Callable[[Column], Column], settings: Settings) -> tuple[DataFrame, Column]:
    """Documents with their sections, and the array of their passages."""
    c = F.col
    sections, chunks = _document_chunks(count, settings)
    rows = docs.select(
        c("key").alias("book"), c("title").alias("book_title"),
        F.coalesce(c("kind"), F.lit("book")).alias("kind"),
        F.coalesce(c("source"), F.lit("")).alias("source"), "slot", "clean_text",
    )
    return rows.withColumn("_sections", sections), chunks


def chunk_arrays(
    docs: DataFrame,
    count: Callable[[Column], Column] = T.token_count,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """``book, book_title, kind, source, slot, chunks``: the passages of cleaned documents, an array each.

    Needs ``key, title, kind, source, slot, clean_text``. Sections, packing and
    the size filter all happen inside the document's row.
    """
    rows, chunks = _sectioned(docs, count, settings)
    return rows.select("book", "book_title", "kind", "source", "slot", chunks.alias("chunks"))


def explode_chunks(arrays: DataFrame, settings: Settings = DEFAULTS, chunks: Column | None = None) -> DataFrame:
    """Passages with their dense ids, one row each, of what :func:`chunk_arrays` gives."""
    c = F.col
    return (
        arrays.select(
            "book", "book_title", "kind", "source", "slot",
            F.posexplode(c("chunks") if chunks is None else chunks).alias("_n", "_chunk"))
        .select(
            (c("slot").cast("bigint") * F.lit(settings.id_stride) + c("_n")).alias("id"),
            "book", "book_title", "kind", "source", "_chunk.*",
        )
        .select(
            "id", "book", "book_title", "kind", "source", "chapter", "section", "section_title",
            "page_start", "page_end", "n_tokens", "text", "embed_text",
        )
    )


def chunk_documents(
    docs: DataFrame,
    count: Callable[[Column], Column] = T.token_count,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Passages of cleaned documents, one row each: a scan with projections and one explode.

    The explode works on the expression itself: on a column of it the planner
    would add a filter that computes it a second time.
    """
    rows, chunks = _sectioned(docs, count, settings)
    return explode_chunks(rows, settings, chunks)


def token_quantiles(chunks: DataFrame) -> DataFrame:
    """Corpus-wide chunk count and order statistics of ``n_tokens``.

    The values at ranks n//2 and int(0.95 n) are picked from the histogram of
    distinct token counts, whose size does not grow with the corpus: no sort
    of all rows and no single-task collection.
    """
    histogram = chunks.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    upto = F.sum("n").over(
        Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = histogram.select("n_tokens", total.alias("total"), upto.alias("upto"))

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col("n_tokens")))

    return ranked.agg(
        F.max("total").alias("chunks"),
        F.min("n_tokens").alias("min_tokens"),
        at(F.floor(F.col("total") / 2)).alias("p50_tokens"),
        at(F.floor(F.col("total") * F.lit(0.95))).alias("p95_tokens"),
        F.max("n_tokens").alias("max_tokens"),
    )
