"""Page-marked text: splitting, rendering, and front/back matter detection.

A document travels as one row; its pages are an array inside that row, so every
operator here is a projection and none of them shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.expr import bind, cut

# The page marker and the line patterns of matter detection.
MARKER = r"^\[PAGE ([0-9]+)\]$"
CONTENTS_HEAD = r"^(?i:(TABLE OF )?CONTENTS)$"
INDEX_HEAD = r"^(INDEX|Index(" + T.SPACE + r"+Terms)?)$"
FOLIO_END = r"[\p{IsWhite_Space}\x1C-\x1F.]\p{Nd}{1,4}$"
INDEX_ENTRY = r"(?d)^[A-Za-z].*?,[\p{Nd},\-–\p{IsWhite_Space}\x1C-\x1F]+$"


def page_number(line: Column) -> Column:
    """Number on a marker line, null for any other line."""
    number = F.regexp_extract(T.strip(line), MARKER, 1)
    return F.when(
        F.contains(line, F.lit("[PAGE ")),
        F.when(number != "", number.try_cast("int")),
    )


def page_array(text: Column) -> Column:
    """``array<struct<page, marker, lines>>`` in document order.

    The first entry holds what stands before the first marker; its page and
    marker are null.
    """
    return page_array_of(F.split(text, "\n"))


def page_array_of(lines: Column) -> Column:
    return bind(
        lines,
        lambda ls: F.transform(
            cut(ls, lambda l: page_number(l).isNotNull()),
            lambda p: F.struct(
                page_number(p["head"]).alias("page"),
                p["head"].alias("marker"),
                p["body"].alias("lines"),
            ),
        ),
    )


def split_pages(text: Column) -> Column:
    """Pages as the detectors see them: a blank unnumbered opening is dropped."""
    return F.filter(
        page_array(text),
        lambda p: p["page"].isNotNull() | F.exists(p["lines"], lambda l: ~T.is_blank(l)),
    )


def page_lines(page: Column) -> Column:
    """The lines of one page with its marker put back in front."""
    return F.when(page["marker"].isNull(), page["lines"]).otherwise(
        F.concat(F.array(page["marker"]), page["lines"])
    )


def join_pages(pages: Column) -> Column:
    return F.array_join(F.flatten(F.transform(pages, page_lines)), "\n")


def line_endings(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def render_page(page: Column, text: Column, offset: Column | None = None) -> Column:
    """One page as marked text; ``offset`` turns file pages into printed ones."""
    printed = page if offset is None else page + F.coalesce(offset, F.lit(0))
    body = T.rstrip(line_endings(text))
    return F.concat(F.lit("[PAGE "), printed.cast("string"), F.lit("]\n"), body, F.lit("\n"))


def extraction_header(
    name: Column, span: Column, title: Column, offset: Column, engine: str
) -> Column:
    """Comment lines that open an extracted text."""
    scope = F.when(
        span.isNotNull(),
        F.concat(F.lit(" pages "), span["lo"].cast("string"), F.lit("-"), span["hi"].cast("string")),
    ).otherwise("")
    numbering = F.when(offset.isNotNull(), "printed folio").otherwise("pdf index")
    return F.concat(
        F.lit("# SOURCE: "), name, scope, F.lit("\n"),
        F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("# TITLE: "), title, F.lit("\n")))
        .otherwise(""),
        F.lit("# PAGES: "), numbering, F.lit("\n"),
        F.lit(
            f"# EXTRACTION: {engine}. Equations are best-effort inline text, "
            "not verified LaTeX.\n\n"
        ),
    )


# ---- what kind of page is it ------------------------------------------------


def inked(lines: Column) -> Column:
    return F.filter(F.transform(lines, T.strip), lambda l: l != "")


def _share(lines: Column, pred) -> Column:
    return F.size(F.filter(lines, pred)) / F.size(lines)


def looks_like_contents(lines: Column) -> Column:
    return bind(
        inked(lines),
        lambda ls: (F.size(ls) >= 6)
        & (
            F.get(ls, F.lit(0)).rlike(CONTENTS_HEAD)
            | (
                (_share(ls, lambda l: F.length(l) < 80) > 0.85)
                & (_share(ls, lambda l: l.rlike(FOLIO_END)) > 0.3)
            )
        ),
    )


def looks_like_index(lines: Column) -> Column:
    return bind(
        inked(lines),
        lambda ls: F.when(F.size(ls) == 0, False)
        .when(F.get(ls, F.lit(0)).rlike(INDEX_HEAD), True)
        .when(F.size(ls) < 8, False)
        .otherwise(_share(ls, lambda l: l.rlike(INDEX_ENTRY)) > 0.45),
    )


def looks_like_body(lines: Column) -> Column:
    return F.size(F.filter(inked(lines), lambda l: F.length(l) > 88)) >= 3


# ---- front and back matter --------------------------------------------------


def front_matter(pages: Column) -> Column:
    """``array<struct<lo, hi>>``: the contents block near the start, if any.

    Only the first 15% of the pages (at least 4) are looked at. The block grows
    from its first contents page over later ones with at most two pages between
    them, then over trailing pages until running prose or a jump of page numbers.
    """

    def judged(ps: Column) -> Column:
        head = F.slice(ps, F.lit(1), F.greatest(F.lit(4), (F.size(ps) * F.lit(0.15)).cast("int")))
        rows = F.array_sort(
            F.transform(
                F.filter(head, lambda p: p["page"].isNotNull()),
                lambda p, at: F.struct(
                    p["page"].alias("page"), at.alias("at"),
                    looks_like_contents(p["lines"]).alias("hit"),
                    looks_like_body(p["lines"]).alias("prose"),
                ),
            )
        )
        # of pages with one number any may be the hit, and the last one has the prose
        return bind(rows, lambda rs: bind(
            F.transform(F.filter(rs, lambda r: r["hit"]), lambda r: r["page"]),
            lambda hits: F.transform(
                F.filter(rs, lambda r, k: ~F.coalesce(F.get(rs, k + 1)["page"] == r["page"], F.lit(False))),
                lambda r: F.struct(r["page"].alias("page"), F.array_contains(hits, r["page"]).alias("hit"), r["prose"].alias("prose")),
            ),
        ))

    def state(hi: Column, done: Column) -> Column:
        return F.struct(hi.cast("int").alias("hi"), done.alias("done"))

    def over_gaps(rows: Column, lo: Column) -> Column:
        return F.aggregate(
            F.filter(rows, lambda r: r["page"] > lo),
            state(lo, F.lit(False)),
            lambda s, r: F.when(s["done"], s)
            .when(r["hit"], state(r["page"], F.lit(False)))
            .otherwise(state(s["hi"], r["page"] - s["hi"] > 2)),
            lambda s: s["hi"],
        )

    def until_prose(rows: Column, hi: Column) -> Column:
        return F.aggregate(
            F.filter(rows, lambda r: r["page"] > hi),
            state(hi, F.lit(False)),
            lambda s, r: F.when(s["done"] | (r["page"] - s["hi"] > 3) | r["prose"], state(s["hi"], F.lit(True)))
            .otherwise(state(r["page"], F.lit(False))),
            lambda s: s["hi"],
        )

    def block(rows: Column) -> Column:
        first = F.get(F.filter(rows, lambda r: r["hit"]), F.lit(0))["page"]
        return bind(
            first,
            lambda lo: bind(
                bind(over_gaps(rows, lo), lambda hi: until_prose(rows, hi)),
                lambda hi: F.when(lo.isNull(), F.array().cast("array<struct<lo:int,hi:int>>"))
                .otherwise(F.array(F.struct(lo.alias("lo"), hi.alias("hi")))),
            ),
        )

    return bind(pages, lambda ps: bind(judged(ps), block))


def back_matter(pages: Column) -> Column:
    """First page of the index at the end of the book, or null.

    The last fifth of the numbered pages is read backwards; up to two pages
    that do not look like an index may interrupt it, and a run spanning fewer
    than three page numbers does not count.
    """

    def nearest_run(hits: Column) -> Column:
        """Of index-like pages, counted from the end, those before the first gap."""
        gap = F.filter(
            F.transform(hits, lambda h, k: F.when((k > 0) & (h["at"] - F.get(hits, k - 1)["at"] > 3), k)),
            lambda k: k.isNotNull(),
        )
        last = F.coalesce(F.get(gap, F.lit(0)), F.size(hits)) - 1
        start, end = F.get(hits, last)["page"], F.get(hits, F.lit(0))["page"]
        return F.when((F.size(hits) > 0) & (end - start >= 2), start)

    def scan(numbered: Column) -> Column:
        skip = (F.size(numbered) * F.lit(0.8)).cast("int")
        tail = F.reverse(F.slice(numbered, skip + 1, F.size(numbered) - skip))
        hits = F.transform(
            tail, lambda p, at: F.when(looks_like_index(p["lines"]), F.struct(at.alias("at"), p["page"].cast("int").alias("page"))))
        return bind(F.filter(hits, lambda h: h.isNotNull()), nearest_run)

    return bind(F.filter(pages, lambda p: p["page"].isNotNull()), scan)


def resolve_matter(
    auto: Column, skip_pages: Column, body_end_page: Column, text: Column, redetect: bool = False
) -> Column:
    """``struct<skip_pages, body_end_page>`` with the detectable gaps filled.

    Only fields listed in ``auto`` are touched, and set ones only on redetect.
    """
    want_front = F.array_contains(auto, "skip_pages") & (
        F.lit(redetect) | (F.coalesce(F.size(skip_pages), F.lit(0)) <= 0)
    )
    want_end = F.array_contains(auto, "body_end_page") & (F.lit(redetect) | body_end_page.isNull())
    return bind(
        F.when(want_front | want_end, split_pages(text)),
        lambda ps: F.struct(
            F.when(want_front, front_matter(ps)).otherwise(skip_pages).alias("skip_pages"),
            F.when(want_end, back_matter(ps)).otherwise(body_end_page).alias("body_end_page"),
        ),
    )
