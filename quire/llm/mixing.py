"""Mixing sources to target weights by temperature, as budgeted block permutations.

Built from DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.frames import prefix_sum
from quire.llm.store import stored

c = F.col
GRID, BITS = 1 << 20, 4  # exponents are multiples of 1 / GRID; each pass over the shares settles BITS halvings
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str) -> Column:
    """Words of a text, runs of anything but ASCII white space; none for a null."""
    return F.coalesce(F.regexp_count(c(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_key(source: str) -> Column:
    """A key that is never null: rows without source are a source of their own."""
    return F.coalesce(F.concat(F.lit("="), c(source).cast("string")), F.lit("-"))


def block_key(block: Column, doc_id: str, text: str, seed: int) -> Column:
    """Place of a document in the permutation of a block."""
    own = F.coalesce(c(doc_id).cast("string"), F.md5(F.coalesce(c(text), F.lit("")).cast("binary")))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), block.cast("string"), own).cast("binary"))


@dataclass(frozen=True)
class Target:
    """What the exponent has to meet.

    ``entropy`` is the least entropy of the weights as a share of the largest
    possible one, ``repetition`` the most passes over any source. If both can't
    be met, the limit on repetition wins.
    """

    entropy: float = 0.95
    repetition: float = 4.0


def exponent(shares: DataFrame, target: Target, budget_share: float | None = None) -> float:
    """The exponent in [0, 1] for the shares ``p`` of the sources, on a grid of 2**-20.

    The entropy falls and repetition gets less as the exponent grows. It is
    the largest that keeps the entropy, or the smallest that keeps the limit on
    repetition if that is larger. Sixteen exponents are tried in one pass over
    the shares, which is four halvings of the interval.
    """
    import math

    first = shares.agg(F.count("*"), F.min("p"), F.max("p")).first()
    if not first[0]:
        return 1.0
    n, least, most = first

    def figures(steps: list[int]) -> list[tuple[float, float]]:
        """Entropy and largest repetition at each exponent."""
        powers = [F.pow(c("p"), F.lit(k / GRID)) for k in steps]
        row = shares.agg(*(F.sum(x) for x in powers), *(F.sum(x * F.ln("p")) for x in powers)).first()
        out = []
        for i, k in enumerate(steps):
            a, z, s = k / GRID, row[i], row[len(steps) + i]
            budget = budget_share if budget_share is not None else z * most ** (1 - a)
            out.append((math.log(z) - a * s / z, least ** (a - 1) * budget / z))
        return out

    def smallest(holds: Callable[[float, float], bool]) -> int:
        """Least step from which on ``holds``; ``GRID + 1`` if it does not even at one."""
        low, width = 0, GRID
        if not holds(*figures([GRID])[0]):
            return GRID + 1
        while width >= 1:  # the answer lies in [low, low + width]
            step = max(1, width >> BITS)
            steps = [min(low + i * step, GRID) for i in range((1 << BITS) + 1)]
            at = next(i for i, x in enumerate(figures(steps)) if holds(*x))
            if at == 0 or step == 1:
                return steps[at]
            low, width = steps[at - 1], step
        return low

    spread = target.entropy * math.log(n) - 1e-9 if n > 1 else -1.0
    by_entropy = smallest(lambda h, _: h < spread) - 1
    by_repetition = min(GRID, smallest(lambda _, r: r <= target.repetition + 1e-9))
    return max(0, min(GRID, max(by_entropy, by_repetition))) / GRID


def source_cuts(
    docs: DataFrame, target: Target, seed: int, budget_share: float | None = None,
) -> DataFrame:
    """``key, weight, budget, blocks, cut`` per source of ``key, doc_id, text_md5, tokens``.

    A source gets ``blocks`` whole permutations and of one more what its budget
    allows: the documents up to the place ``cut`` (null: none of them).
    """
    sums = stored(docs.groupBy("key").agg(F.sum("tokens").alias("tokens")), "sources")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    shares = sums.where("tokens > 0").withColumn("p", c("tokens") / F.lit(float(total or 1)))
    a = exponent(shares, target, budget_share)
    z, most = shares.agg(F.sum(F.pow("p", F.lit(a))), F.max("p")).first()
    budget = total * (budget_share if budget_share is not None else (z or 1.0) * (most or 1.0) ** (1 - a))
    weights = shares.select("key", "tokens", (F.pow("p", F.lit(a)) / F.lit(z or 1.0)).alias("weight"))
    plan = sums.select("key").join(weights, "key", "left").select(
        "key", F.coalesce("tokens", F.lit(0).cast("long")).alias("tokens"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
    plan = plan.withColumn("budget", F.round(c("weight") * F.lit(float(budget)), 0).cast("long"))
    plan = stored(plan.withColumn("blocks", F.when(c("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(1).cast("long"))).withColumn(
        "rest", c("budget") - c("blocks") * c("tokens")), "plan")
    places = docs.join(plan.where("rest > 0").select("key", "blocks", "rest"), "key").withColumn(
        "place", F.md5(F.concat_ws(":", F.lit(str(seed)), c("blocks").cast("string"), "own").cast("binary")))
    upto = prefix_sum(
        places.groupBy("key", "rest", "place").agg(F.sum("tokens").alias("tokens")),
        ["place"], c("tokens"), ["key"], "upto")
    cuts = upto.where("upto <= rest").groupBy("key").agg(F.max("place").alias("cut"))
    return plan.join(cuts, "key", "left").select("key", "weight", "budget", "blocks", "cut")


def mix(
    df: DataFrame, target: Target = Target(), seed: int = 7, budget_share: float | None = None,
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """The columns of ``df`` with ``block, place, n_tokens``, a row per document and block it is in.

    Source shares of all tokens (words) are raised to an exponent found by
    bisection for the target, and normalised to weights. The budget in tokens is
    ``budget_share`` of all tokens, by default the least that gives each source
    one whole block. Each source then yields permutations of its documents,
    block 0, 1, ..., ordered by ``place``; the last one ends where the budget of
    the source does, so every budget is met to less than one document.

    Only the sums of the sources and the places of documents are shuffled, the
    documents themselves meet a row per source. A row without source belongs to
    a source of its own; one without id takes its place by its text; a repeated
    row is repeated. A source without any token is given once. Columns of ``df``
    named like a result are replaced.
    """
    new = ("block", "place", "n_tokens")
    extra = [x for x in df.columns if x not in new]
    rows = df.select(*(F.col(f"`{x}`") for x in extra))
    own = F.coalesce(c(doc_id).cast("string"), F.md5(F.coalesce(c(text), F.lit("")).cast("binary")))
    narrow = stored(rows.select(source_key(source).alias("key"), own.alias("own"), n_words(text).alias("tokens")), "tokens")
    cuts = stored(source_cuts(narrow, target, seed, budget_share), "cuts").select(
        c("key").alias("_key"), c("blocks").alias("_blocks"), c("cut").alias("_cut"))
    blocks = F.sequence(F.lit(0).cast("long"), c("_blocks"))
    return (
        rows.join(cuts, source_key(source) == c("_key"))
        .withColumn("block", F.explode(blocks))
        .withColumn("place", block_key(c("block"), doc_id, text, seed))
        .where((c("block") < c("_blocks")) | (c("place") <= c("_cut")))
        .select(*(F.col(f"`{x}`") for x in extra), "block", "place", n_words(text).alias("n_tokens"))
    )
