"""Text predicates and transforms as Column expressions.

Character classes are spelled out instead of using ``\\w``/``\\s``/``\\b``: the
JVM's defaults are ASCII and change between Java versions.
"""

from __future__ import annotations

from collections.abc import Iterator
from unicodedata import normalize as normalize_text

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.config import DEFAULTS
from quire.functions.arrow import by_bytes
from quire.functions.expr import bind

# Code points that count as white space, newline apart.
SPACE_CODES = (
    0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008,
    0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
SPACE_CHARS = "\n" + "".join(map(chr, SPACE_CODES))
# the same set for the regex engine, as a property test instead of 30 alternatives
SPACE = r"[\p{IsWhite_Space}\x1C-\x1F]"
GAP = r"[\p{IsWhite_Space}\x1C-\x1F&&[^\n]]"
INK = r"[^\p{IsWhite_Space}\x1C-\x1F]"
WORD = r"[\p{L}\p{N}_]"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

# Words that never become part of a document key.
KEY_STOP_WORDS = (
    "the", "and", "with", "for", "series", "edition", "wiley", "press",
    "ieee", "inc", "compress", "analysis", "vol",
)

# Characters folded or deleted after compatibility normalization.
FOLDS = {
    0x00A0: " ", 0x2007: " ", 0x202F: " ", 0x2009: " ", 0x200A: " ", 0x2002: " ",
    0x2003: " ", 0x2018: "'", 0x2019: "'", 0x201C: '"', 0x201D: '"', 0x2032: "'",
    0x2013: "-", 0x2014: "-", 0x2010: "-", 0x2011: "-",
    0x00AD: "", 0x200B: "", 0xFEFF: "",
}
# translate() deletes what has no counterpart, so the deletions go last
FOLD_FROM = "".join(chr(c) for c in sorted(FOLDS, key=lambda c: FOLDS[c] == ""))
FOLD_TO = "".join(FOLDS[ord(c)] for c in FOLD_FROM)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACE_CHARS))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def squeeze(c: Column) -> Column:
    """White-space runs to one space, ends trimmed."""
    return strip(F.regexp_replace(c, SPACE + "+", " "))


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]+", ""))


def capitals(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{Lu}]+", ""))


def is_upper(c: Column) -> Column:
    """At least one capital and no small letter."""
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"[\p{Ll}\p{Lt}]")


def alpha_ratio(c: Column) -> Column:
    dense = F.length(F.replace(c, F.lit(" "), F.lit("")))
    return F.when(dense == 0, 0.0).otherwise(letters(c) / dense)


def is_prose(c: Column) -> Column:
    """Long enough, with spaces, mostly letters and not mostly capitals."""

    def judged(t: Column) -> Column:
        dense = F.length(F.replace(t, F.lit(" "), F.lit("")))
        return (F.length(t) >= 25) & F.contains(t, F.lit(" ")) & bind(
            letters(t), lambda n: (n / dense >= 0.72) & (capitals(t) / n <= 0.8)
        )

    return bind(strip(c), judged)


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def short_key(c: Column) -> Column:
    """First two telling words of a file stem, at most 24 characters."""
    whole = slug(c)
    words = F.filter(
        F.split(whole, "_"),
        lambda w: (F.length(w) > 2) & ~w.rlike("^[0-9]+$") & ~w.isin(*KEY_STOP_WORDS),
    )
    fallback = F.when(whole == "", "doc").otherwise(F.substring(whole, 1, 12))
    joined = F.array_join(F.slice(words, 1, 2), "_")
    return F.substring(F.when(F.size(words) > 0, joined).otherwise(fallback), 1, 24)


def title_of_stem(c: Column) -> Column:
    return strip(F.regexp_replace(c, "_+", " "))


def stem(path: Column) -> Column:
    """File name without directories and without its last suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def source_label(path: Column) -> Column:
    """The folders a file was filed under, joined with `` / ``."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " / ")


def is_shouty(title: Column, ratio: float = DEFAULTS.shouty_ratio) -> Column:
    """Mostly upper-case words; titles without a word of 3+ letters count too."""
    words = F.filter(F.split(title, SPACE + "+"), lambda w: F.length(w) > 2)
    loud = F.size(F.filter(words, is_upper))
    return F.when(F.size(words) == 0, True).otherwise(loud / F.size(words) > ratio)


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(INK + "+"))


def token_count(c: Column) -> Column:
    """Token estimate used when no tokenizer is plugged in."""
    return (word_count(c) * F.lit(1.35)).cast("int") + 1


def fold(c: Column) -> Column:
    return F.translate(c, FOLD_FROM, FOLD_TO)


@F.arrow_udf(StringType())
def _nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for part in by_bytes(batch):
            yield pa.array([x if x is None else normalize_text("NFKC", x) for x in part.to_pylist()], pa.string())


def normalize(c: Column) -> Column:
    """Compatibility normalization, then the folding table.

    Spark has no normalization built in. Plain ASCII is a fixed point, so those
    texts go to the Python worker as nulls and cost no transfer.
    """
    foreign = F.when(c.rlike(r"[^\x00-\x7F]"), c)
    return fold(F.coalesce(_nfkc(foreign), c))


def tokens(c: Column) -> Column:
    """Lower-case word tokens in text order."""
    return F.regexp_extract_all(F.lower(c), F.lit(rf"({WORD}+)"), 1)


def content_hash(c: Column) -> Column:
    """Content identity that ignores CRLF/LF differences."""
    return F.md5(F.replace(c, F.lit("\r\n"), F.lit("\n")))
