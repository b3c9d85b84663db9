"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.store import stored

c = F.col


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
    ).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the edges ``a, b`` (longs).

    The component is its smallest node. Large-star and small-star rounds: each
    hangs the neighbours of a node under their minimum, until every component
    is a star. Minima are grouped sums with map-side combine and joined back,
    so a node with very many edges is never one group; the rounds grow with
    the logarithm of the longest chain. Null ends and loops are ignored.
    """
    edges = stored(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(c("b").alias("a"), c("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(c("b").alias("a"), c("m").alias("b")).distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").where("b <> m").select(c("b").alias("a"), c("m").alias("b"))
        edges = stored(small.unionByName(below.select("a", c("m").alias("b"))).distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(c("b").alias("node"), c("b").alias("component")).distinct()
    return edges.select(c("a").alias("node"), c("b").alias("component")).unionByName(roots)
