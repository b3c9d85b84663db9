"""Registering files: keys, slots, outlines, issue splitting, pruning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.config import DEFAULTS, Settings
from quire.functions import text as T
from quire.functions.expr import bind
from quire.functions.frames import durable, prefix_sum, small

# Titles, bookmarks and files that are not papers.
SKIP_TITLE = (
    rf"(?i)^{T.SPACE}*(table of )?contents(?![\p{{L}}\p{{N}}_])|^{T.SPACE}*cover(?![\p{{L}}\p{{N}}_])|^{T.SPACE}*front cover|^{T.SPACE}*back cover|"
    rf"^{T.SPACE}*(guest )?editorial(?![\p{{L}}\p{{N}}_])|^{T.SPACE}*information for authors|^{T.SPACE}*call for papers|"
    rf"^{T.SPACE}*(z{T.SPACE}+)?regular papers{T.SPACE}*$|^{T.SPACE}*special issue papers{T.SPACE}*$|"
    rf"^{T.SPACE}*\p{{Nd}}{{0,5}}{T.SPACE}*ieee transactions on(?![\p{{L}}\p{{N}}_]).*(?<![\p{{L}}\p{{N}}_])vol\.|"
    rf"^{T.SPACE}*instructions? for authors|^{T.SPACE}*\p{{Nd}}{{4}} index(?![\p{{L}}\p{{N}}_])|^{T.SPACE}*index(?![\p{{L}}\p{{N}}_])|"
    rf"^{T.SPACE}*ieee (transactions|xplore)(?![\p{{L}}\p{{N}}_]).*(?<![\p{{L}}\p{{N}}_])contents(?![\p{{L}}\p{{N}}_])|^{T.SPACE}*blank page"
)
SKIP_BOOKMARK = r"(?i)contents|cover|editorial|adverti|masthead|call[-_ ]?for|index|blank"
INDEX_FILE = r"(?i)(?<![\p{L}\p{N}_])index(?![\p{L}\p{N}_]).*(?<![\p{L}\p{N}_])vol"
RUNNING_TITLE = r"(?i)^ieee(?![\p{L}\p{N}_])"
PRINTED_NUMBER = r"(?<![\p{L}\p{N}_])(\p{Nd}{1,5})(?![\p{L}\p{N}_])"

TURNS = 50_000  # rows that one task names one after the other


def path_order(path: str) -> Column:
    """Sorts paths folder by folder: the separator comes before any other character."""
    return F.replace(F.col(path), F.lit("/"), F.lit("\x01"))


def distinct_files(files: DataFrame) -> DataFrame:
    """One path per (length, lower-case name), the first in path order.

    A minimum is combined before the shuffle, so many copies of one file cost
    one row per task.
    """
    name = F.lower(T.basename(F.col("path")))
    return (
        files.filter(~T.basename(F.col("path")).rlike("^[~.]"))
        .groupBy("length", name.alias("name"))
        .agg(F.min_by("path", path_order("path")).alias("path"))
    )


# ---- keys and slots ---------------------------------------------------------


def article_key(path: Column, index: Column, title: Column) -> Column:
    hint = F.substring(T.slug(F.coalesce(title, F.lit(""))), 1, 24)
    return F.concat(
        F.substring(T.slug(T.stem(path)), 1, 28), F.lit("_"),
        F.when(index < 100, F.lpad(index.cast("string"), 2, "0")).otherwise(index.cast("string")),
        F.when(hint != "", F.concat(F.lit("_"), hint)).otherwise(""),
    )


def free_numbers(
    new: DataFrame, used: DataFrame, order: str, group: list[str], start: int
) -> DataFrame:
    """``order, group, number``: the smallest unused numbers from ``start``, in order.

    The k-th new row (from 0) gets ``start + k`` plus the count of used numbers
    that lie below its result; a used number with f free ones below it does so as
    soon as f <= k. Both sides are merged on that value and counted by a running
    sum, so neither a large group nor a long list of used numbers is collected.
    """
    ranked = prefix_sum(used.select(*group, "number").distinct(), ["number"], group=group, name="r")
    free_below = F.col("number") - F.lit(start) - F.col("r") + 1
    below = ranked.groupBy(*group, free_below.alias("at")).agg(F.count(F.lit(1)).alias("add"))
    queue = prefix_sum(new.select(order, *group), [order], group=group, name="k")
    merged = below.select(
        *group, "at", F.lit(0).alias("side"), "add", F.lit(None).cast("string").alias(order)
    ).unionByName(
        queue.select(
            *group, (F.col("k") - 1).alias("at"), F.lit(1).alias("side"),
            F.lit(0).cast("bigint").alias("add"), order,
        )
    )
    summed = prefix_sum(merged, ["at", "side"], F.col("add"), group=group, name="shift")
    return summed.filter(F.col("side") == 1).select(
        order, *group, (F.lit(start) + F.col("at") + F.col("shift")).alias("number")
    )


def unique_keys(wanted: DataFrame, taken: DataFrame, order: str = "path") -> DataFrame:
    """``order, base, key``: bases made unique among themselves and against ``taken``.

    Row by row in order, a row gets the first of base, base_2, base_3 ... that
    is neither taken nor given to a row before it.

    A base alone is numbered in one pass. Bases meet only where one is another
    one with a number, such as x_2 and x: there the row that comes first gets
    the name. Which one that is depends on the names below it, so it is settled
    in rounds, from small numbers up, until nothing changes. Only rows of such
    bases take part, and where no more than ``TURNS`` rows have a root in common
    a task names them in turn.
    """
    c = F.col
    base = F.when(F.coalesce(c("base"), F.lit("")) == "", "doc").otherwise(c("base"))
    # narrow, and read several times below
    rows = durable(wanted.select(c(order).cast("string").alias(order), base.alias("base")))
    bases = durable(rows.groupBy("base").agg(F.min(order).alias("since")))

    def numbered(names: DataFrame, *more: str) -> DataFrame:
        number = F.regexp_extract("name", "_([1-9][0-9]{0,17})$", 1).try_cast("bigint")
        return names.filter(number >= 2).select(
            F.regexp_replace("name", "_[0-9]+$", "").alias("base"), number.alias("number"), *more
        )

    names = taken.select(c("key").alias("name")).distinct()
    one = F.lit(1).cast("bigint").alias("number")
    held = durable(names.select(c("name").alias("base"), one).unionByName(numbered(names)).join(
        bases.select("base"), "base", "left_semi"))
    # rivals: bases that another base would come to with a number, and are not taken anyway
    rivals = numbered(bases.select(c("base").alias("name"), "since"), "name", "since").join(
        bases.select("base"), "base", "left_semi").join(names, "name", "left_anti")
    rivals = durable(rivals)
    if rivals.isEmpty():
        return named(_numbered_apart(rows, held, order), order)
    # only bases with a rival depend on each other; all others are numbered once
    tense = durable(rivals.select("base").union(rivals.select("name")).distinct())
    calm = _numbered_apart(rows.join(small(tense), "base", "left_anti"), held, order)
    rows = durable(rows.join(small(tense), "base", "left_semi").withColumn("root", root(c("base"))))
    # bases that depend on each other have one root; where few rows share it they are named one by one
    crowded = durable(rows.groupBy("root").count().where(c("count") > TURNS).select("root"))
    few = _by_turns(rows.join(crowded, "root", "left_anti"), names, order)
    calm = calm.unionByName(few)
    if crowded.isEmpty():
        return named(calm, order)
    rows = durable(rows.join(crowded, "root", "left_semi").drop("root"))
    held = durable(held.join(small(tense), "base", "left_semi"))
    rivals = durable(rivals.withColumn("root", root(c("name"))).join(crowded, "root", "left_semi").drop("root"))
    ahead = rivals.select("name")  # rivals that come before the other base gets there
    while True:
        won = rivals.join(ahead, "name", "left_semi")
        lost = rivals.join(ahead, "name", "left_anti")
        blocked = held.unionByName(won.select("base", "number")).unionByName(lost.select(c("name").alias("base"), one))
        given = durable(free_numbers(rows, blocked, order, ["base"], 1))
        # the row that gets the number, or would have got it: numbers ascend with the rows
        reached = rivals.join(given, "base").where(given["number"] >= rivals["number"]).groupBy("name").agg(F.min(order).alias("at"))
        now = durable(
            rivals.join(reached, "name", "left").where("at is null or since < at").select("name"))
        if now.join(ahead, "name", "left_anti").isEmpty() and ahead.join(now, "name", "left_anti").isEmpty():
            break
        ahead = now
    return named(calm.unionByName(given), order)


def root(base: Column) -> Column:
    """A base without the numbers at its end."""
    return F.regexp_replace(base, "(_[0-9]+)+$", "")


def _by_turns(rows: DataFrame, names: DataFrame, order: str) -> DataFrame:
    """``order, base, number``: the rows of each root (at most ``TURNS``) named one after the other."""
    columns = [order, "base", "number"]

    def run(own: pd.DataFrame, taken: pd.DataFrame) -> pd.DataFrame:
        used, following, out = set(taken["name"]), {}, []
        for at, base in own.sort_values(order)[[order, "base"]].itertuples(index=False):
            number = following.get(base, 1)
            while (name := base if number == 1 else f"{base}_{number}") in used:
                number += 1
            used.add(name)
            following[base] = number + 1
            out.append((at, base, number))
        return pd.DataFrame(out, columns=columns)

    taken = names.select("name", root(F.col("name")).alias("root"))
    return rows.groupBy("root").cogroup(taken.join(rows.select("root").distinct(), "root", "left_semi").groupBy("root")).applyInPandas(
        run, f"{order} string, base string, number bigint")


def named(given: DataFrame, order: str) -> DataFrame:
    """``order, base, key`` from the number that each row of a base has got."""
    c = F.col
    return given.select(
        order, "base",
        F.when(c("number") == 1, c("base")).otherwise(F.concat("base", F.lit("_"), c("number").cast("string"))).alias("key"))


def _numbered_apart(rows: DataFrame, held: DataFrame, order: str) -> DataFrame:
    """``order, base, number``: as ``free_numbers``, which only bases with a taken number have to go through.

    A row alone with its base is number one; rows of a base of which nothing is
    taken are just counted.
    """
    counts = rows.groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    state = durable(counts.join(held.select("base").distinct().withColumn("held", F.lit(True)), "base", "left"))
    alone = state.where("held is null and n = 1").select("base")
    several = state.where("held is null and n > 1").select("base")
    met = state.where("held").select("base")
    out = rows.join(alone, "base", "left_semi").select(order, "base", F.lit(1).cast("bigint").alias("number"))
    if not several.isEmpty():
        counted = prefix_sum(rows.join(several, "base", "left_semi"), [order], group=["base"], name="number")
        out = out.unionByName(counted.select(order, "base", "number"))
    if not met.isEmpty():
        out = out.unionByName(free_numbers(rows.join(met, "base", "left_semi"), held, order, ["base"], 1))
    return out


def free_slots(new: DataFrame, used: DataFrame, order: str = "path") -> DataFrame:
    """``order, slot``: the smallest unused slot numbers, in order."""
    taken = used.filter(F.col("slot") >= 0).select(F.col("slot").alias("number"))
    rows = new.select(F.col(order).cast("string").alias(order))
    return free_numbers(rows, taken, order, [], 0).withColumnRenamed("number", "slot")


# ---- outlines ---------------------------------------------------------------


def top_outline(toc: DataFrame) -> DataFrame:
    """Outline entries of the outermost level of each file, titles trimmed."""
    top = toc.groupBy("pdf").agg(F.min("level").alias("level"))
    return (
        toc.join(small(top), ["pdf", "level"], "left_semi")
        .filter(F.col("page") > 0)
        .select("pdf", "ord", T.strip(F.col("title")).alias("title"), "page")
    )


def article_spans(outline: DataFrame, page_counts: DataFrame) -> DataFrame:
    """``pdf, nth, title, lo, hi`` page ranges between outline entries.

    Entries are numbered by a running sum and meet their successor by number, so
    one file with most of the entries is still spread over all tasks.
    """
    entries = prefix_sum(outline.select("pdf", "ord", "title", "page"), ["page", "ord"], group=["pdf"], name="at")
    following = entries.select("pdf", (F.col("at") - 1).alias("at"), (F.col("page") - 1).alias("_end"))
    spans = (
        entries.join(following, ["pdf", "at"], "left")
        .join(small(page_counts), "pdf")
        .select("pdf", "at", "title", F.col("page").alias("lo"), F.coalesce("_end", "page_count").alias("hi"))
        .filter(F.col("hi") >= F.col("lo"))
    )
    # positions count over the spans that are left
    return prefix_sum(spans, ["at"], group=["pdf"], name="nth").select(
        "pdf", F.col("nth").cast("int").alias("nth"), "title", "lo", "hi"
    )


def issues(outline: DataFrame, page_counts: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``pdf, page_count, marks, is_issue``: long files with many outline entries."""
    marks = outline.groupBy("pdf").agg(F.count(F.lit(1)).alias("marks"))
    return page_counts.join(marks, "pdf", "left").select(
        "pdf", "page_count", F.coalesce("marks", F.lit(0)).alias("marks"),
        (
            (F.col("page_count") >= settings.min_issue_pages)
            & (F.coalesce("marks", F.lit(0)) >= settings.min_article_bookmarks)
        ).alias("is_issue"),
    )


def tenths(size: str) -> Column:
    """A size rounded to one digit by its binary value, ties to the even digit.

    What is left above the whole number is exact, so it is compared with the
    ten borders; at a border itself the binary value of that border decides.
    """
    rest = F.col(size) - F.floor(size)
    borders = [k / 100 for k in range(5, 100, 10)]
    passed = [((rest >= b) if round(b, 1) > b else (rest > b)).cast("int") for b in borders]
    return (F.floor(size) * 10 + sum(passed[1:], passed[0])) / F.lit(10.0)


def page_titles(spans: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``pdf, page, title``: the largest type on a page that reads like a title."""
    text = T.strip(F.col("text"))
    title = T.squeeze(
        F.array_join(F.transform(F.sort_array("words"), lambda w: w["text"]), " ")
    )
    by_size = (
        spans.filter(text != "")
        .groupBy("pdf", "page", tenths("size").alias("size"))
        .agg(F.collect_list(F.struct(F.rint("y").alias("y"), F.rint("x").alias("x"), text.alias("text"))).alias("words"))
        .select("pdf", "page", "size", title.alias("title"))
    )
    good = (
        F.length("title").between(settings.min_title, settings.max_title)
        & ~F.col("title").rlike(RUNNING_TITLE)
        & (T.letters(F.col("title")) >= 10)
    )
    return by_size.groupBy("pdf", "page").agg(
        F.coalesce(F.max_by("title", F.when(good, F.col("size"))), F.lit("")).alias("title")
    )


def folio_candidates(text: Column, settings: Settings = DEFAULTS) -> Column:
    """Distinct integers that may be folios in the first and last inked lines."""
    head, foot, most = settings.folio_head, settings.folio_foot, settings.folio_most

    def numbers(lines: Column) -> Column:
        # the last ones may overlap the first ones, as short pages do
        edge = F.concat(
            F.slice(lines, 1, head),
            F.slice(lines, F.greatest(F.size(lines) - (foot - 1), F.lit(1)), F.lit(foot)),
        )
        found = F.flatten(
            F.transform(edge, lambda l: F.regexp_extract_all(l, F.lit(PRINTED_NUMBER), 1))
        )
        return F.filter(
            F.array_distinct(F.transform(found, lambda x: x.try_cast("int"))),
            lambda v: v.between(1, most),
        )

    inked = F.filter(F.transform(F.split(text, "\n"), T.strip), lambda l: l != "")
    return bind(inked, numbers)


def page_offsets(spans: DataFrame, pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``pdf, page_offset``: printed minus file page number, where enough articles agree.

    Votes of the first eight articles; equal counts go to the smaller offset.
    """
    # spans are numbered without gaps; a few rows per file, so the pages' texts stay where they are
    sample = spans.filter(F.col("nth") <= settings.offset_sample).select("pdf", F.col("lo").alias("page"))
    votes = (
        pages.join(small(sample), ["pdf", "page"])
        .select("pdf", "page", F.explode(folio_candidates(F.col("text"), settings)).alias("value"))
        .select("pdf", (F.col("value") - F.col("page")).alias("offset"))
        .filter(F.col("offset").between(settings.offset_low, settings.offset_high))
        .groupBy("pdf", "offset")
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    best = votes.groupBy("pdf").agg(F.max(F.struct("votes", (-F.col("offset")).alias("o"))).alias("b"))
    return spans.select("pdf").distinct().join(best, "pdf", "left").select(
        "pdf", F.when(F.col("b.votes") >= settings.offset_quorum, -F.col("b.o")).alias("page_offset")
    )


def keep_article(bookmark: Column, title: Column, lo: Column, hi: Column,
                 settings: Settings = DEFAULTS) -> Column:
    """Whether a span of an issue is registered as an article."""
    return (
        (hi - lo + 1 >= settings.min_article_pages)
        & ~bookmark.rlike(SKIP_BOOKMARK)
        & (F.coalesce(title, F.lit("")) != "")
        & ~title.rlike(SKIP_TITLE)
    )


def is_volume_index(path: Column) -> Column:
    return T.basename(path).rlike(INDEX_FILE)


def doomed(kind: Column, title: Column, settings: Settings = DEFAULTS) -> Column:
    """Registered articles that turn out not to be papers."""
    return (kind == "article") & (title.rlike(SKIP_TITLE) | T.is_shouty(title, settings.shouty_ratio))


def prune(registry: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return registry.filter(~F.coalesce(doomed(F.col("kind"), F.col("title"), settings), F.lit(False)))


# ---- registration -----------------------------------------------------------


def triage(files: DataFrame, registry: DataFrame) -> DataFrame:
    """``path, status``: known, moved (same file name elsewhere), index or new."""
    known = registry.filter(F.col("pdf").isNotNull())
    paths = known.select(F.col("pdf").alias("path")).distinct().withColumn("_known", F.lit(True))
    names = known.select(T.basename(F.col("pdf")).alias("_name")).distinct().withColumn("_moved", F.lit(True))
    return (
        files.select("path", T.basename(F.col("path")).alias("_name"))
        .join(paths, "path", "left")
        .join(names, "_name", "left")
        .select(
            "path",
            F.when(F.col("_known"), "known")
            .when(F.col("_moved"), "moved")
            .when(is_volume_index(F.col("path")), "index")
            .otherwise("new")
            .alias("status"),
        )
    )


def follow_moves(registry: DataFrame, triaged: DataFrame) -> DataFrame:
    """Registry with the paths of moved files updated; the last path wins."""
    moved = (
        triaged.filter(F.col("status") == "moved")
        .groupBy(T.basename(F.col("path")).alias("_name"))
        .agg(F.max("path").alias("_to"))
    )
    return (
        registry.withColumn("_name", T.basename(F.col("pdf")))
        .join(moved, "_name", "left")
        .withColumn("pdf", F.coalesce("_to", "pdf"))
        .drop("_name", "_to")
    )


def new_documents(
    triaged: DataFrame, structure: DataFrame, articles: DataFrame, registry: DataFrame,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Registry rows for new files: one per file, or one per article of an issue.

    ``structure`` has ``path, page_count, is_issue, title`` (title of page one);
    ``articles`` has ``path, nth, bookmark, title, lo, hi, page_offset``.
    """
    new = triaged.filter(F.col("status") == "new").select("path").join(structure, "path")
    bulk = F.col("page_count") >= settings.min_issue_pages
    stem = T.stem(F.col("path"))
    named = F.when(bulk | (F.coalesce("title", F.lit("")) == ""), T.title_of_stem(stem)).otherwise(F.col("title"))
    whole = new.filter(~F.col("is_issue")).select(
        F.concat(path_order("path"), F.lit("\x01")).alias("ref"), T.short_key(stem).alias("base"), "path",
        named.alias("title"), F.when(bulk, "issue").otherwise("article").alias("kind"),
        F.lit(None).cast("struct<lo:int,hi:int>").alias("pages"),
        F.lit(None).cast("int").alias("page_offset"),
        F.array(*map(F.lit, ("title", "skip_pages", "body_end_page"))).alias("auto"),
    )
    parts = (
        new.filter("is_issue").select("path").join(articles, "path")
        .filter(keep_article(F.col("bookmark"), F.col("title"), F.col("lo"), F.col("hi"), settings))
        .select(
            # ten digits hold any int, so the order of the texts is that of the numbers
            F.concat(path_order("path"), F.lit("\x01"), F.lpad(F.col("nth").cast("string"), 10, "0")).alias("ref"),
            article_key(F.col("path"), F.col("nth"), F.col("title")).alias("base"), "path", "title",
            F.lit("article").alias("kind"),
            F.struct(F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi")).alias("pages"),
            F.col("page_offset").cast("int").alias("page_offset"), F.array().cast("array<string>").alias("auto"),
        )
    )
    rows = whole.unionByName(parts)
    keys = unique_keys(rows.select("ref", "base"), registry.select("key"), order="ref")
    slots = free_slots(rows.select("ref"), registry.select("slot"), order="ref")
    return (
        rows.drop("base").join(keys.drop("base"), "ref").join(slots, "ref")
        .select(
            "key", F.col("path").alias("pdf"), "title", "kind", T.source_label(F.col("path")).alias("source"),
            "slot", "pages", "page_offset", F.array().cast("array<struct<lo:int,hi:int>>").alias("skip_pages"),
            F.lit(None).cast("int").alias("body_end_page"), "auto",
        )
    )


# ---- extraction bookkeeping -------------------------------------------------


def pages_in_span(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of each document cut out of a shared file, numbered as printed.

    The page range is spelled out, so the match is an equi-join and a file's
    pages are read once for all of its articles.
    """
    wanted = documents.select(
        "key", "pdf", "page_offset", F.explode(F.sequence(F.col("lo"), F.col("hi"))).alias("page")
    )
    return wanted.join(pages, ["pdf", "page"]).select(
        "key", "pdf", "page", (F.col("page") + F.coalesce("page_offset", F.lit(0))).alias("printed"), "text"
    )


def text_layer(pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``key, pages, chars, needs_ocr``: too little text per page to be one."""
    chars = F.sum(F.length(T.strip(F.col("text"))))
    return (
        pages.groupBy("key")
        .agg(F.count(F.lit(1)).alias("pages"), chars.alias("chars"))
        .withColumn("needs_ocr", F.col("chars") / F.greatest("pages", F.lit(1)) < settings.ocr_threshold)
    )


def extract_status(rows: DataFrame, force: bool = False) -> DataFrame:
    """``key, status``. Needs has_pdf, has_text, pdf_hash, file_hash, needs_ocr.

    A stored hash counts as current only if it equals the file's.
    """
    keep = F.col("has_text") & ~F.lit(force)
    return rows.select(
        "key",
        F.when(~F.col("has_pdf"), F.when(F.col("has_text"), "no pdf").otherwise("MISSING"))
        .when(keep & (F.col("pdf_hash") == F.col("file_hash")), "cached")
        .when(keep & F.col("pdf_hash").isNull(), "adopted")
        .when(F.coalesce("needs_ocr", F.lit(False)), "NO TEXT LAYER")
        .otherwise("extracted")
        .alias("status"),
    )
