"""Cleaning of extracted text, document by document.

Each step is a Column expression over the text or line array of one row. The
whole cleaning is therefore a map over documents: it runs where the scan runs,
without an exchange, and a large document costs only its own task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.config import DEFAULTS, Settings
from quire.functions import text as T
from quire.functions.expr import bind, remembered
from quire.operators import pages as P

# The line patterns the cleaning rules are defined by.
FOLIO = r"^\p{Nd}{1,4}$"
ROMAN = r"^(?i:[ivxlcdm]{1,6})$"
SCANNED_HEADER = (
    r"(?d)^(\p{Nd}{1,4}_+.{0,60}?_+(Chapter_+\p{Nd}+|Appendix_+[A-Z])"
    r"|(Chapter_+\p{Nd}+|Appendix_+[A-Z]_+.{0,60}?_+\p{Nd}{1,4})"
    r"|Section_+\p{Nd}+\.\p{Nd}+\..{0,60}?_+\p{Nd}{1,4})$"
).replace("_", T.SPACE)
JUNK = r"^([^\p{L}\p{N}_]{1,3}|[. ·]+)$"
SENTENCE_STOPS = (".", ":", ";", "!", "?", '"', "'", ")")

CAPTION_BLOCK = (
    rf"\n({T.GAP}*(?:FIGURE|TABLE|Figure|Table){T.GAP}+\p{{Nd}}+[-.–]?\p{{Nd}}*{T.EDGE}[^\n]*"
    # the block runs on over non-blank lines; possessive, so long runs use no stack
    rf"(?:\n(?={T.GAP}*+{T.INK})[^\n]++)*+)"
)
COMPOUND = r"(?<![\p{L}\p{N}_])([A-Za-z]{2,}-[A-Za-z]{2,})(?![\p{L}\p{N}_])"

_BLANK = rf"(?:{T.GAP}*\n)"
_MARK = rf"(?:{T.GAP}*\[PAGE [0-9]+\]{T.GAP}*\n)"
# up to three lines may stand between the halves of a word, one of them a marker
_BETWEEN = (
    rf"((?:{_MARK}{_BLANK}{{0,2}}|{_BLANK}{_MARK}{_BLANK}?|{_BLANK}{_BLANK}{_MARK}|{_BLANK}{{0,3}}))"
)
SPLIT_WORD_PARTS = rf"-{T.GAP}*\n{_BETWEEN}{T.GAP}*([a-z]{{2,}})(?![\p{{L}}\p{{N}}_])([^\n]*)"
SPLIT_WORD = SPLIT_WORD_PARTS.replace("-", r"-(?<=[A-Za-z]{2}-)", 1)

# noncharacters, reserved for use inside a program
WEAK, STRONG = chr(0xFDD0), chr(0xFDD1)


def trim_matter(pages: Column, skip_pages: Column, end_page: Column) -> Column:
    """``struct<pages, dropped>`` without skipped pages and everything from ``end_page``.

    ``dropped`` counts the lines of skipped pages, markers included, and one for
    the stop.
    """

    def trimmed(ps: Column) -> Column:
        stops = F.transform(ps, lambda p: F.coalesce(p["page"] >= end_page, F.lit(False)))
        return bind(
            F.array_position(stops, True),
            lambda stop: bind(
                F.when(stop > 0, F.slice(ps, F.lit(1), (stop - 1).cast("int"))).otherwise(ps),
                lambda live: F.struct(
                    F.filter(live, lambda p: ~skipped(p)).alias("pages"),
                    (
                        F.aggregate(
                            F.filter(live, skipped),
                            F.lit(0),
                            lambda n, p: n + 1 + F.size(p["lines"]),
                        )
                        + F.when(stop > 0, 1).otherwise(0)
                    ).alias("dropped"),
                ),
            ),
        )

    def skipped(p: Column) -> Column:
        return F.coalesce(
            F.exists(skip_pages, lambda r: p["page"].between(r["lo"], r["hi"])), F.lit(False)
        )

    return bind(pages, trimmed)


def banner_pattern(settings: Settings = DEFAULTS) -> str | None:
    patterns = [p for p in settings.banner_patterns if p]
    return "|".join(f"(?:{p})" for p in patterns) or None


def drop_banners(lines: Column, pattern: str | None) -> Column:
    return lines if pattern is None else F.filter(lines, lambda l: ~l.rlike(pattern))


def running_headers(lines: Column) -> Column:
    """Distinct short shouted or chapter-like lines occurring three times or more.

    The few candidates are sorted, and one equal to its second predecessor has
    been seen three times -- no counting table, no shuffle.
    """
    candidates = F.filter(
        F.transform(lines, T.strip),
        lambda s: (F.length(s) <= 75)
        & (T.is_upper(s) | s.rlike(SCANNED_HEADER))
        & (T.letters(s) >= 6),
    )
    return bind(
        F.array_sort(candidates),
        lambda c: F.array_distinct(F.filter(c, lambda s, i: F.get(c, i - 2).eqNullSafe(s))),
    )


def strip_furniture(pages: Column, headers: Column) -> Column:
    """Pages without headers and folios within two lines of a page break."""

    def swept(ps: Column, hs: Column) -> Column:
        def removable(s: Column) -> Column:
            return (s != "") & (
                s.rlike(FOLIO) | s.rlike(ROMAN) | F.array_contains(hs, s)
            )

        def sweep(p: Column, k: Column) -> Column:
            n = F.size(p["lines"])
            return F.struct(
                p["page"].alias("page"),
                p["marker"].alias("marker"),
                F.filter(
                    p["lines"],
                    lambda l, i: ~(
                        ((p["page"].isNotNull() & (i < 2)) | ((k < F.size(ps) - 1) & (i >= n - 2)))
                        & removable(T.strip(l))
                    ),
                ).alias("lines"),
            )

        return F.transform(ps, sweep)

    return bind(headers, lambda hs: bind(pages, lambda ps: swept(ps, hs)))


def lift_captions(pages: Column) -> Column:
    """Caption blocks moved to the end of their page, so split sentences rejoin."""

    def lift(p: Column) -> Column:
        def rebuilt(body: Column) -> Column:
            blocks = F.regexp_extract_all(body, F.lit(CAPTION_BLOCK), 1)
            kept = F.split(F.regexp_replace(body, CAPTION_BLOCK, ""), "\n")
            return bind(
                kept,
                lambda ks: F.concat(
                    ks,
                    F.when(T.is_blank(F.element_at(ks, -1)), F.array().cast("array<string>"))
                    .otherwise(F.array(F.lit(""))),
                    F.flatten(
                        F.transform(blocks, lambda b: F.concat(F.split(b, "\n"), F.array(F.lit(""))))
                    ),
                ),
            )

        return F.struct(
            p["page"].alias("page"),
            p["marker"].alias("marker"),
            F.when(has_caption(p), bind(F.array_join(p["lines"], "\n"), rebuilt))
            .otherwise(p["lines"])
            .alias("lines"),
        )

    return F.transform(pages, lift)


def has_caption(p: Column) -> Column:
    return F.array_join(p["lines"], "\n").rlike(CAPTION_BLOCK)


def count_captions(pages: Column) -> Column:
    return F.aggregate(
        pages,
        F.lit(0),
        lambda n, p: n + F.regexp_count(F.array_join(p["lines"], "\n"), F.lit(CAPTION_BLOCK)),
    )


def hyphen_lexicon(text: Column) -> Column:
    """Distinct compounds the document writes with its hyphen inside a line."""
    return F.array_distinct(
        F.transform(F.regexp_extract_all(text, F.lit(COMPOUND), 1), F.lower)
    )


def fix_hyphenation(text: Column, lexicon: Column) -> Column:
    """``struct<text, joined>`` with words split at line ends put together.

    The hyphen stays where the document writes the compound elsewhere. Matches
    cannot overlap, so the tail of a joined line is not joined again.
    """

    def candidate(head: Column, word: Column) -> Column:
        return F.concat(
            F.lower(F.regexp_extract(head, "([A-Za-z]+)$", 1)), F.lit("-"), F.lower(word)
        )

    def split_word(match: Column) -> Column:
        marker = F.regexp_extract(match, r"(\[PAGE [0-9]+\])", 1)
        return F.struct(
            F.regexp_extract(match, SPLIT_WORD_PARTS, 2).alias("word"),
            F.concat(
                T.rstrip(F.regexp_extract(match, SPLIT_WORD_PARTS, 3)),
                F.when(marker != "", F.concat(F.lit("\n"), marker)).otherwise(""),
            ).alias("rest"),
        )

    def assembled(parts: Column, tails: Column) -> Column:
        joins = F.zip_with(
            F.slice(parts, F.lit(1), F.size(tails)),
            tails,
            lambda head, t: F.struct(head.alias("head"), t["word"].alias("word"), t["rest"].alias("rest"),
                                     candidate(head, t["word"]).alias("compound")),
        )
        # only candidates matter: intersect first so that lookups stay short
        return bind(
            joins,
            lambda js: bind(
                F.array_intersect(F.transform(js, lambda j: j["compound"]), lexicon),
                lambda known: F.concat(
                    F.array_join(
                        F.transform(
                            js,
                            lambda j: F.concat(
                                j["head"],
                                F.when(F.array_contains(known, j["compound"]), "-").otherwise(""),
                                j["word"],
                                j["rest"],
                            ),
                        ),
                        "",
                    ),
                    F.element_at(parts, -1),
                ),
            ),
        )

    def fixed(t: Column) -> Column:
        return bind(
            F.regexp_extract_all(t, F.lit(SPLIT_WORD), 0),
            lambda found: F.struct(
                F.when(F.size(found) == 0, t)
                .otherwise(
                    bind(
                        F.split(t, SPLIT_WORD),
                        lambda parts: assembled(parts, F.transform(found, split_word)),
                    )
                )
                .alias("text"),
                F.size(found).alias("joined"),
            ),
        )

    return bind(text, fixed)


def drop_junk(lines: Column) -> Column:
    return F.filter(lines, lambda l: ~T.strip(l).rlike(JUNK))


def reflow(lines: Column) -> Column:
    """Text of the lines with hard-wrapped prose joined into paragraphs.

    A line continues its predecessor when both are prose, the predecessor does
    not end a sentence and the line starts small or with a bracket. Such a link
    is strong when the predecessor has 45 characters; within a run of links
    everything from the first strong one on is joined. One blank between prose
    and a line starting small is closed first.
    """

    def facts(l: Column) -> Column:
        return bind(
            T.rstrip(l),
            lambda s: F.struct(
                s.alias("s"),
                T.is_prose(s).alias("prose"),
                F.substring(s, -1, 1).isin(*SENTENCE_STOPS).alias("stop"),
                F.substring(T.strip(s), 1, 1).alias("first"),
            ),
        )

    def small(x: Column) -> Column:
        return x["first"].between("a", "z")

    def bridged(xs: Column) -> Column:
        return F.filter(
            xs,
            lambda x, i: ~(
                (x["s"] == "")
                & F.coalesce(
                    F.get(xs, i - 1)["prose"]
                    & ~F.get(xs, i - 1)["stop"]
                    & F.get(xs, i + 1)["prose"]
                    & small(F.get(xs, i + 1)),
                    F.lit(False),
                )
            ),
        )

    def linked(xs: Column) -> Column:
        def link(x: Column, i: Column) -> Column:
            before = F.get(xs, i - 1)
            continues = (
                before["prose"] & ~before["stop"] & x["prose"] & (small(x) | (x["first"] == "("))
            )
            sign = (
                F.when(~F.coalesce(continues, F.lit(False)), "\n")
                .when(F.length(before["s"]) >= 45, STRONG)
                .otherwise(WEAK)
            )
            return F.concat(F.when(i == 0, "").otherwise(sign), x["s"])

        return F.array_join(F.transform(xs, link), "")

    def settled(run: Column) -> Column:
        at = F.instr(run, STRONG)
        joined = F.regexp_replace(
            F.substring(run, at, F.length(run)), f"[{WEAK}{STRONG}]{T.GAP}*", " "
        )
        head = F.substring(run, F.lit(1), F.greatest(at - 1, F.lit(0)))
        return F.when(at == 0, F.translate(run, WEAK, "\n")).otherwise(
            F.concat(F.translate(head, WEAK, "\n"), joined)
        )

    runs = bind(F.transform(lines, facts), lambda xs: bind(bridged(xs), linked))
    return F.array_join(F.transform(F.split(runs, "\n"), settled), "\n")


def collapse_blanks(lines: Column) -> Column:
    """Right-trimmed lines with every run of blanks reduced to one."""
    return bind(
        F.transform(lines, T.rstrip),
        lambda ls: F.filter(ls, lambda l, i: (l != "") | (i == 0) | (F.get(ls, i - 1) != "")),
    )


def clean_signature(text_hash: Column, skip_pages: Column, end_page: Column,
                    settings: Settings = DEFAULTS) -> Column:
    """What a cleaning depends on: the text, the trim settings, the banners."""
    return F.concat_ws(
        "|",
        text_hash,
        F.to_json(skip_pages),
        F.coalesce(end_page.cast("string"), F.lit("None")),
        F.md5(F.lit("|".join(settings.banner_patterns))),
    )


@remembered
def _steps(settings: Settings) -> tuple[tuple[str, Column], ...]:
    """The cleaning in order, each step naming the column it adds."""
    c = F.col

    def line_total(pages: Column) -> Column:
        return F.aggregate(pages, F.lit(0), lambda n, p: n + F.size(p["lines"]))

    stats = F.struct(
        F.size(F.split(c("text"), "\n")).alias("lines_in"),
        c("_trim.dropped").alias("matter_dropped"),
        (F.size("_norm") - F.size("_lines")).alias("banners"),
        (line_total(c("_pages")) - line_total(c("_swept"))).alias("furniture"),
        count_captions(c("_swept")).alias("captions_moved"),
        c("_whole.joined").alias("hyphens_joined"),
        (F.size("_words") - F.size("_sound")).alias("junk"),
        F.size("_out").alias("lines_out"),
        T.word_count(c("clean_text")).alias("words_out"),
        F.size(F.filter(c("_out"), lambda l: P.page_number(l).isNotNull())).alias("pages"),
    )
    return (
        ("_trim", trim_matter(P.page_array(c("text")), c("skip_pages"), c("body_end_page"))),
        ("_norm", F.split(T.normalize(P.join_pages(c("_trim.pages"))), "\n")),
        ("_lines", drop_banners(c("_norm"), banner_pattern(settings))),
        ("_pages", P.page_array_of(c("_lines"))),
        ("_swept", strip_furniture(c("_pages"), running_headers(c("_lines")))),
        ("_lifted", P.join_pages(lift_captions(c("_swept")))),
        ("_whole", fix_hyphenation(c("_lifted"), hyphen_lexicon(c("_lifted")))),
        ("_words", F.split(c("_whole.text"), "\n")),
        ("_sound", drop_junk(c("_words"))),
        ("_out", collapse_blanks(F.split(reflow(c("_sound")), "\n"))),
        ("clean_text", F.concat(T.strip(F.array_join(c("_out"), "\n")), F.lit("\n"))),
        ("stats", stats),
    )


def clean(docs: DataFrame, settings: Settings = DEFAULTS, keep_steps: bool = False) -> DataFrame:
    """Adds ``clean_text`` and the ``stats`` struct to rows of extracted text.

    Needs ``text``, ``skip_pages`` and ``body_end_page``. Every step is its own
    projection so that each intermediate array is computed once; ``keep_steps``
    leaves those arrays in the result.
    """
    for name, column in _steps(settings):
        docs = docs.withColumn(name, column)
    return docs if keep_steps else docs.drop(*(n for n, _ in _steps(settings) if n.startswith("_")))


def render_clean(raw_text: Column, clean_text: Column) -> Column:
    """A cleaned document as written to disk, its comment lines in front."""
    header = F.filter(F.slice(F.split(raw_text, "\n"), 1, 3), lambda l: l.startswith("#"))
    return F.concat(
        F.array_join(header, "\n"),
        F.lit("\n# CLEANED: matter trimmed, banners/headers removed, reflowed\n\n"),
        clean_text,
    )
