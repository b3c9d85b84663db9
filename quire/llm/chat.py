"""Chat formatting: a dialogue seen by each of its speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.frames import prefix_sum

c = F.col
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def plain(text: Column) -> Column:
    """Text that cannot be taken for a marker; nothing for a null."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def perspectives(
    df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    part_turns: int = 256, system: str = "system",
) -> DataFrame:
    """A row per dialogue, speaker and part: ``conv_id, speaker, part, n_turns, n_own, rendered, mask``.

    For every speaker but the system the dialogue is rendered with the turns of
    that speaker as ``assistant`` and those of the others as ``user`` with their
    name; system turns stay system turns. ``mask`` has the ranges of characters
    to train on, ``start-end`` joined by commas: the speaker's own words and the
    closing marker after them. Turns are ordered by ``turn``, then role and text.

    A dialogue of more than ``part_turns`` turns comes in parts, whose texts one
    after the other are the whole rendering; ranges count within a part. So no
    task needs a whole dialogue, however long it is. Speakers and turns meet in
    a join, which adaptive execution splits for a long dialogue.

    A null text is an empty turn. A turn without role is one of a user named
    ``unknown``, who gets no rendering. Rows without conv_id are a dialogue of
    their own. A dialogue of system turns only has no speaker and gives no row.
    Repeated rows are repeated turns.
    """
    rows = df.select(
        c(conv_id).alias("conv_id"), F.coalesce(c(conv_id).cast("string"), F.lit("-")).alias("_conv"),
        c(turn).alias("turn"), c(role).alias("role"), plain(c(text)).alias("text"),
    )
    ranked = prefix_sum(rows, ["turn", "role", "text"], group=["_conv"], name="_nth").withColumn(
        "part", F.floor((c("_nth") - 1) / part_turns).cast("int"))
    speakers = rows.where((c("role") != system) & c("role").isNotNull()).select("_conv", c("role").alias("speaker")).distinct()
    own = F.coalesce(c("role") == c("speaker"), F.lit(False))
    head = (
        F.when(own, F.lit("assistant")).when(c("role") == system, F.lit(system))
        .otherwise(F.concat(F.lit("user name="), F.coalesce(F.regexp_replace("role", r"[<|>\s]", "_"), F.lit("unknown"))))
    )
    seen = ranked.join(speakers, "_conv").select(
        "_conv", "conv_id", "speaker", "part", "_nth", own.alias("own"),
        F.concat(F.lit(OPEN), head, F.lit("\n")).alias("head"),
        F.concat("text", F.lit(CLOSE)).alias("body"),
    )
    so_far = Window.partitionBy("_conv", "speaker", "part").orderBy("_nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = seen.withColumn("end", F.sum(F.length("head") + F.length("body") + 1).over(so_far) - 1)
    spans = F.when(c("own"), F.concat_ws("-", c("end") - F.length("body"), "end"))
    turns = F.array_sort(F.collect_list(F.struct("_nth", F.concat("head", "body", F.lit("\n")).alias("shown"), spans.alias("span"))))
    return placed.groupBy("_conv", "speaker", "part").agg(
        F.first("conv_id").alias("conv_id"), F.count("*").alias("n_turns"), F.count_if("own").alias("n_own"), turns.alias("turns"),
    ).select(
        "conv_id", "speaker", "part", "n_turns", "n_own", F.array_join("turns.shown", "").alias("rendered"),
        F.array_join(F.filter("turns.span", lambda x: x.isNotNull()), ",").alias("mask"),
    )
