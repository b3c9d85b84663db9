"""Headings, sections and paragraphs of a cleaned text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.config import DEFAULTS, Settings
from quire.functions import text as T
from quire.functions.expr import bind, cut
from quire.operators import pages as P

# Heading shapes of books and of papers, and the roman numerals.
BOOK_HEADING = (
    r"(?d)^(\p{Nd}{1,2})\.(\p{Nd}{1,2})(?:\.(\p{Nd}{1,2}))?" + T.SPACE + r"+([A-Z].{3,90})$"
)
PAPER_SECTION = r"(?d)^([IVX]{1,5})\." + T.SPACE + r"+([A-Z][A-Za-z].{2,90})$"
PAPER_SUBSECTION = r"(?d)^([A-Z])\." + T.SPACE + r"+([A-Z][A-Za-z].{2,90})$"
TRAILING_FOLIO = T.SPACE + r"\p{Nd}{1,4}$"
ROMANS = (
    "I", "II", "III", "IV", "V", "VI", "VII", "VIII",
    "IX", "X", "XI", "XII", "XIII", "XIV", "XV",
)

HEADING_TYPE = "struct<chapter:int,section:string,title:string>"


def _heading(chapter: Column, section: Column, title: Column) -> Column:
    return F.struct(
        chapter.cast("int").alias("chapter"), section.alias("section"), title.alias("title")
    )


def book_heading(line: Column, settings: Settings = DEFAULTS) -> Column:
    """``struct<chapter, section, title>`` of a line like ``3.4.6 Field Mapping``."""

    def parsed(t: Column) -> Column:
        def part(n: int) -> Column:
            return F.regexp_extract(t, BOOK_HEADING, n)

        title = T.strip(part(4))
        chapter = part(1).try_cast("int")
        label = F.concat_ws(".", part(1), part(2), F.when(part(3) != "", part(3)))
        good = (
            chapter.between(1, settings.max_chapter)
            & ~title.rlike(TRAILING_FOLIO)
            & ~title.endswith(",")
            & (T.letters(title) >= 4)
        )
        return F.when(
            t.rlike(BOOK_HEADING) & good,
            _heading(chapter, label, F.regexp_replace(title, T.SPACE + "+", " ")),
        )

    return bind(T.strip(line), parsed)


def paper_section(line: Column) -> Column:
    """A roman-numbered section heading of a paper."""

    def parsed(t: Column) -> Column:
        numeral = F.regexp_extract(t, PAPER_SECTION, 1)
        title = T.squeeze(F.regexp_extract(t, PAPER_SECTION, 2))
        number = F.array_position(F.array(*map(F.lit, ROMANS)), numeral)
        good = (number > 0) & (T.letters(title) >= 3) & ~title.rlike(TRAILING_FOLIO)
        return F.when(t.rlike(PAPER_SECTION) & good, _heading(number, numeral, title))

    return bind(T.strip(line), parsed)


def paper_subsection(line: Column) -> Column:
    """A lettered heading; only one inside a roman section counts."""

    def parsed(t: Column) -> Column:
        title = T.squeeze(F.regexp_extract(t, PAPER_SUBSECTION, 2))
        good = (F.length(title) <= 70) & (T.letters(title) >= 3)
        return F.when(
            t.rlike(PAPER_SUBSECTION) & good,
            _heading(F.lit(None), F.regexp_extract(t, PAPER_SUBSECTION, 1), title),
        )

    return bind(T.strip(line), parsed)


def body_lines(text: Column) -> Column:
    """``array<struct<line, page>>`` without markers and comment lines."""
    tagged = F.transform(
        P.page_array(text),
        lambda p: F.transform(
            p["lines"], lambda l: F.struct(T.rstrip(l).alias("line"), p["page"].alias("page"))
        ),
    )
    return F.filter(F.flatten(tagged), lambda x: ~x["line"].startswith("#"))


def parse_sections(text: Column, kind: Column, settings: Settings = DEFAULTS) -> Column:
    """``array<struct<chapter, section, title, blocks>>`` in reading order.

    Blocks are ``struct<text, page_start, page_end>`` paragraphs. A paragraph
    starts on the first known page of its lines and ends on the page where the
    blank line, heading or end of text after it stands. Sections without a
    paragraph are dropped.
    """
    article = kind == "article"

    def plain_heading() -> Column:
        return _heading(
            F.lit(None), F.lit(None).cast("string"),
            F.when(kind == "book", "front matter").otherwise("abstract"),
        )

    def outer(x: Column) -> Column:
        return F.when(article, paper_section(x["line"])).otherwise(
            book_heading(x["line"], settings)
        )

    def stop_page(piece: Column, fallback: Column) -> Column:
        return F.when(piece["last"], fallback).otherwise(piece["stop"]["page"])

    def paragraph(piece: Column, fallback: Column) -> Column:
        pages = F.filter(
            F.transform(piece["body"], lambda x: x["page"]), lambda p: p.isNotNull()
        )
        return F.struct(
            T.strip(F.array_join(F.transform(piece["body"], lambda x: x["line"]), "\n")).alias("text"),
            F.get(pages, F.lit(0)).alias("page_start"),
            stop_page(piece, fallback).alias("page_end"),
        )

    def blocks(body: Column, fallback: Column) -> Column:
        pieces = F.filter(
            cut(body, lambda x: T.is_blank(x["line"])), lambda p: F.size(p["body"]) > 0
        )
        return F.transform(pieces, lambda p: paragraph(p, fallback))

    def section(heading: Column, body: Column, fallback: Column) -> Column:
        return F.struct(
            heading["chapter"].alias("chapter"),
            heading["section"].alias("section"),
            heading["title"].alias("title"),
            bind(body, lambda b: blocks(b, fallback)).alias("blocks"),
        )

    def subsections(piece: Column, last_page: Column) -> Column:
        """One piece between roman headings, cut again at lettered ones."""
        fallback = stop_page(piece, last_page)

        def below(major: Column) -> Column:
            def label(head: Column) -> Column:
                return F.when(head.isNull(), major).otherwise(
                    bind(
                        paper_subsection(head["line"]),
                        lambda h: _heading(
                            major["chapter"],
                            F.concat_ws(".", major["section"], h["section"]),
                            h["title"],
                        ),
                    )
                )

            return bind(
                piece["body"],
                lambda body: F.transform(
                    cut(body, lambda x: paper_subsection(x["line"]).isNotNull()),
                    lambda q: section(label(q["head"]), q["body"], stop_page(q, fallback)),
                ),
            )

        opening = F.array(section(plain_heading(), piece["body"], fallback))
        return F.when(piece["head"].isNull(), opening).otherwise(
            bind(paper_section(piece["head"]["line"]), below)
        )

    def assemble(lines: Column, last_page: Column) -> Column:
        pieces = cut(lines, lambda x: outer(x).isNotNull())

        def of_book(piece: Column) -> Column:
            heading = F.when(piece["head"].isNull(), plain_heading()).otherwise(
                book_heading(piece["head"]["line"], settings)
            )
            return F.array(section(heading, piece["body"], stop_page(piece, last_page)))

        return F.filter(
            F.flatten(
                F.transform(
                    pieces,
                    lambda p: F.when(article, subsections(p, last_page)).otherwise(of_book(p)),
                )
            ),
            lambda s: F.size(s["blocks"]) > 0,
        )

    return bind(
        body_lines(text),
        lambda lines: bind(
            # page numbers only change at markers, so the last marker is the end's page
            F.element_at(F.transform(P.page_array(text), lambda p: p["page"]), -1),
            lambda last: assemble(lines, last),
        ),
    )
