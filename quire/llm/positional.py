"""Benchmark decontamination on a distributed positional inverted index.

The index is a table of postings, one row per occurrence of a term: document,
position, term. It is split by documents and sorted by term inside each part,
so it is written by one map over the texts, a term that stands in every
document is no hot key, and a list is read by skipping pages of other terms.

A phrase is looked up from its rarest term: that term's positions, less its
offset in the phrase, are the places where the phrase may begin. The list of
the second rarest term, adjusted by its own offset, is intersected with them,
and what is left is intersected with the lists of all other terms at once.
Everything is a join of tables; no Python runs in a task.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.frames import small
from quire.llm.store import stored

c = F.col
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # ASCII but letters and digits ends a word
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROWS = 500_000  # so many document numbers, of 8 bytes, are broadcast at most


class Index(NamedTuple):
    """``lists``: row, pos (from 1), tid. ``documents``: row, n_words, doc (struct). ``terms``: tid, term."""

    lists: DataFrame
    documents: DataFrame
    terms: DataFrame


class Phrases(NamedTuple):
    """``windows``: wid, words, distinct. ``owners``: wid, item."""

    windows: DataFrame
    owners: DataFrame


def lowered(word: Column) -> Column:
    """``word`` with A-Z in lower case and nothing else changed."""
    plain = F.octet_length(word) == F.char_length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def cut(text: Column) -> Column:
    """An empty string, the words as they are written, and perhaps an empty string again."""
    return F.split(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))), BREAK)


def words_of(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.transform(F.filter(cut(text), lambda x: x != ""), lowered)


def number_terms(words: DataFrame) -> DataFrame:
    """``tid, term`` of the distinct values of the column ``term``."""
    return stored(words.select("term").distinct().select(F.monotonically_increasing_id().alias("tid"), "term"), "terms")


def build_index(docs: DataFrame, terms: DataFrame | None = None, text: str = "text") -> Index:
    """Postings of ``docs``, written to the shared folder.

    With ``terms`` (tid, term) only their lists are kept; without, those of
    every word. Documents are told apart by row, so ids may be null or repeat;
    all columns but the text are kept with the document under ``doc``, so no
    name clashes. A null or empty text is a document without words.
    """
    found = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.struct(*(c(f"`{x}`") for x in docs.columns if x != text)).alias("doc"), cut(c(f"`{text}`")).alias("words"))
    n_words = F.size("words") - 1 - (F.element_at("words", -1) == "").cast("int")
    # the empty string in front of the words stands for the document itself
    found = found.select("row", "doc", n_words.cast("long").alias("n_words"), F.posexplode("words").alias("pos", "word"))
    found = found.where("pos = 0 or word <> ''").withColumn("term", lowered(c("word")))
    if terms is None:
        terms = number_terms(found.where("pos > 0"))
    head = c("pos") == 0
    postings = found.join(small(terms), "term", "left").where(head | c("tid").isNotNull()).select(
        "row", "pos", "tid", *(F.when(head, c(x)).alias(x) for x in ("n_words", "doc")))
    table = stored(postings.sortWithinPartitions("tid"), "postings")
    return Index(table.where("pos > 0").select("row", "pos", "tid"), table.where("pos = 0").select("row", "n_words", "doc"), terms)


def phrases(items: DataFrame, size: int, item_id: str = "item_id", text: str = "text") -> Phrases:
    """Every ``size`` consecutive words of every item; a shorter item is one phrase, one without words none."""
    words = items.select(c(f"`{item_id}`").cast("string").alias("item"), words_of(c(f"`{text}`")).alias("w")).where("size(w) > 0")
    all_windows = words.select("item", "w", F.explode(F.expr(f"sequence(1, greatest(1, size(w) - {size - 1}))")).alias("i")).select(
        "item", F.array_join(F.slice("w", c("i"), size), " ").alias("phrase")).distinct()
    all_windows = stored(all_windows, "phrases")
    windows = stored(all_windows.select("phrase").distinct().select(F.monotonically_increasing_id().alias("wid"), "phrase"), "windows")
    owners = all_windows.join(windows, "phrase").where("item is not null").select("wid", "item")
    return Phrases(windows.select("wid", F.split("phrase", " ").alias("words")), owners)


def plan(index: Index, windows: DataFrame) -> DataFrame:
    """``wid, size, nth, off, tid``: the terms of each phrase from the rarest, for phrases whose terms all have a list."""
    counts = stored(index.lists.groupBy("tid").agg(F.count("*").alias("n")), "counts")
    counts = counts.join(index.terms, "tid")
    asked = windows.select("wid", F.size("words").alias("size"), F.posexplode("words").alias("off", "term"))
    own = Window.partitionBy("wid")
    return stored(
        asked.join(small(counts), "term")
        .withColumn("nth", F.row_number().over(own.orderBy("n", "tid", "off")))
        .withColumn("known", F.count("*").over(own)).where("known = size").select("wid", "size", "nth", "off", "tid"), "plan")


def few(rows: DataFrame) -> DataFrame | None:
    """The distinct ``row`` of ``rows`` for a broadcast, or nothing if there are too many."""
    rows = rows.select("row").distinct()
    return F.broadcast(rows) if rows.limit(ROWS + 1).count() <= ROWS else None


def begin(index: Index, ranked: DataFrame) -> DataFrame:
    """``wid, row, start``: where each phrase would begin by the list of its rarest term."""
    first = small(ranked.where("nth = 1"))
    return index.lists.join(first, "tid").select("wid", "row", (c("pos") - c("off")).alias("start")).where("start > 0")


def intersect(index: Index, places: DataFrame, ranked: DataFrame) -> DataFrame:
    """The ``places`` at which every term of ``ranked`` stands at its offset; a phrase without such a term is dropped."""
    need = places.join(small(ranked), "wid").select("wid", "row", "start", (c("start") + c("off")).alias("pos"), "tid")
    lists = index.lists.join(small(ranked.select("tid").distinct()), "tid", "left_semi")
    rows = few(places)
    if rows is not None:
        lists = lists.join(rows, "row", "left_semi")
    sizes = small(ranked.groupBy("wid").agg(F.count("*").alias("asked")))
    found = need.join(lists, ["row", "pos", "tid"]).groupBy("wid", "row", "start").agg(F.count("*").alias("n"))
    return found.join(sizes, "wid").where("n = asked").select("wid", "row", "start")


def phrase_matches(index: Index, windows: DataFrame) -> DataFrame:
    """``wid, row, start, size`` of every occurrence of every phrase, by offset-adjusted lists from the rarest term."""
    ranked = plan(index, windows)
    sizes = ranked.where("nth = 1").select("wid", "size")
    at = stored(begin(index, ranked).join(small(sizes), "wid"), "places")
    done = [at.where("size = 1")]
    for step, least in (("nth = 2", 2), ("nth > 2", 3)):
        at = stored(intersect(index, at.where(f"size >= {least}").select("wid", "row", "start"), ranked.where(step)).join(small(sizes), "wid"), "places")
        done.append(at.where("size = 2") if least == 2 else at)
    return done[0].unionByName(done[1]).unionByName(done[2]).select("wid", "row", "start", "size")


def proximity_matches(index: Index, windows: DataFrame, within: int) -> DataFrame:
    """``wid, row, pos``: occurrences of a phrase's rarest term with every other term of it at most ``within`` words away.

    Order and repetitions do not matter. Lists are cut into cells of
    ``within + 1`` positions, so terms meet by equal cells.
    """
    ranked = plan(index, windows)
    cell = within + 1
    first = ranked.where("nth = 1").select("wid", c("tid").alias("rarest"))
    others = stored(ranked.join(first, "wid").where("tid <> rarest").select("wid", "tid").distinct(), "others")
    asked = others.groupBy("wid").agg(F.count("*").alias("asked"))
    anchors = index.lists.join(small(first), c("tid") == c("rarest")).select("wid", "row", "pos")
    anchors = stored(anchors.join(small(asked), "wid", "left"), "anchors")
    need = anchors.where("asked > 0").join(small(others), "wid").select(
        "wid", "row", "pos", "asked", "tid",
        F.explode(F.expr(f"sequence(greatest(0, pos - {within}) div {cell}, (pos + {within}) div {cell})")).alias("cell"))
    lists = index.lists.join(small(others.select("tid").distinct()), "tid", "left_semi").select(
        "row", "tid", c("pos").alias("at"), F.expr(f"pos div {cell}").alias("cell"))
    near = need.join(lists, ["row", "tid", "cell"]).where(F.abs(c("at") - c("pos")) <= within)
    near = near.select("wid", "row", "pos", "asked", "tid").distinct().groupBy("wid", "row", "pos", "asked").agg(F.count("*").alias("n"))
    return near.where("n = asked").select("wid", "row", "pos").unionByName(anchors.where("asked is null").select("wid", "row", "pos"))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with ``n_words, n_hit, items, contaminated``, a row for each row.

    ``n_hit`` counts the words that an occurrence of ``size`` consecutive words
    of an item covers; ``items`` are the ids of such items as strings, sorted
    and distinct. An item of fewer words is looked for as a whole; a null or
    wordless one is not. An item without id covers words but is not listed;
    rows that repeat an id are one item. Repeated rows and rows without id of
    ``docs`` are judged each for itself, a null text has no words, and a column
    of ``docs`` named like a result gives way to it. Without documents or
    items, there is nothing to find.
    """
    asked = phrases(items, size)
    terms = number_terms(asked.windows.select(F.explode("words").alias("term")))
    index = build_index(docs, terms, text)
    found = stored(phrase_matches(index, asked.windows), "matches")
    covered = found.select("row", F.explode(F.expr("sequence(start, start + size - 1)")).alias("pos")).distinct().groupBy("row").agg(
        F.count("*").alias("n_hit"))
    hits = found.select("wid", "row").distinct().join(small(asked.owners), "wid").select("row", "item").distinct().groupBy("row").agg(
        F.array_sort(F.collect_list("item")).alias("items"))
    n_hit = F.coalesce(c("n_hit"), F.lit(0).cast("long"))
    new = {"n_words": c("n_words"), "n_hit": n_hit, "items": F.coalesce(c("items"), F.array().cast("array<string>")), "contaminated": n_hit > 0}
    kept = [c("doc").getField(x).alias(x) for x in docs.columns if x != text and x not in new]
    return index.documents.join(covered, "row", "left").join(hits, "row", "left").select(*kept, *(x.alias(n) for n, x in new.items()))
