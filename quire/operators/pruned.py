"""Top-k search that passes over points which cannot be among the best.

Two indexes, one idea. Points lie in cells, and a cell's summary bounds what a
query can score there:

* sparse: postings by term and cell, with the largest and smallest weight of
  the term in the cell; a query's bound is the sum over its terms,
* dense: cells around pivots, with the smallest and largest angle between a
  point and its pivot; by the triangle inequality a query at a known angle to
  the pivot cannot be closer to any point of the cell than their difference.

A search reads summaries first. The cells with the best bounds, as many as it
takes to hold the points asked for, are scored; their n-th best score is a
floor, and of all other cells only those are read whose bound reaches it. The
result is exact whatever the data; how much is read depends on them and is
reported.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.frames import small, stored
from quire.operators.retrieval import Best, QueryBlock

c = F.col
DIGITS = 6
BLOCK = 4096  # ids to a cell of postings
ENTRIES = 1 << 21  # entries of a cell that one task holds
QUERIES = 4096  # queries that a task scores a cell of postings for
GROUP = 20_000  # points of a cell that one task scores
HIT = "qid bigint, id bigint, score double"
LISTS = "term bigint, cell bigint, least double, most double, size bigint, entries array<struct<id:bigint,weight:double>>"


class Postings(NamedTuple):
    """``lists``: term, cell (its smallest id), least, most, size, entries (id, weight), sorted by term within a cell."""

    lists: DataFrame


class Cells(NamedTuple):
    """``points``: cell, id, dense. ``summary``: cell, size, near, far (cosines to the pivot). ``pivots``: unit vectors."""

    points: DataFrame
    summary: DataFrame
    pivots: np.ndarray


def ranked(scored: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.select("qid", "id", "score", F.row_number().over(order).alias("rank")).where(c("rank") <= n)


def settle(bounds: DataFrame, score: Callable[[DataFrame], DataFrame], n: int, digits: int = DIGITS) -> tuple[DataFrame, DataFrame]:
    """The ``n`` best of every query, and what it took.

    ``bounds`` has ``qid, cell, bound, size``, where at least ``size`` points of
    the cell can be scored; ``score`` gives ``qid, id, score`` of the cells
    named by ``qid, cell``. The second table has ``qid, cells, points`` and how
    many of them were read: ``cells_read, points_read``.
    """
    bounds = stored(bounds, "bounds")
    order = Window.partitionBy("qid").orderBy(F.desc("bound"), "cell")
    # a cell holds a point at least, so no more than n of them are needed
    top = bounds.withColumn("nth", F.row_number().over(order)).where(c("nth") <= n)
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seeds = stored(top.withColumn("before", before).where(c("before") < n).select("qid", "cell", "size"), "seeds")
    first = stored(ranked(score(seeds.select("qid", "cell")), n), "first")
    floor = first.groupBy("qid").agg(F.count("*").alias("found"), F.min("score").alias("floor"))
    reached = (F.coalesce(c("found"), F.lit(0)) < n) | (c("bound") >= c("floor") - 10.0 ** -digits)  # scores are rounded, bounds are not
    rest = bounds.join(small(seeds.select("qid", "cell")), ["qid", "cell"], "left_anti").join(small(floor), "qid", "left").where(reached)
    rest = stored(rest.select("qid", "cell", "size"), "rest")
    hits = ranked(first.select("qid", "id", "score").unionByName(score(rest.select("qid", "cell"))), n)
    read = seeds.unionByName(rest).groupBy("qid").agg(F.count("*").alias("cells_read"), F.sum("size").alias("points_read"))
    visits = bounds.groupBy("qid").agg(F.count("*").alias("cells"), F.sum("size").alias("points")).join(read, "qid")
    return hits, visits


# ---- sparse -----------------------------------------------------------------


def entries(vectors: DataFrame, *keys: str) -> DataFrame:
    """``keys``, ``term, weight`` of sparse vectors; a term that a vector repeats counts with the sum, null weights do not."""
    each = vectors.select(*keys, F.explode(F.arrays_zip("terms", "weights")).alias("x")).select(
        *keys, c("x.terms").alias("term"), c("x.weights").cast("double").alias("weight"))
    return each.where("term is not null and weight is not null")


def inverted(ids: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    """The lists of a cell, sorted by term, from its entries in the order of their ids."""
    order = np.argsort(terms, kind="stable")
    ids, terms, weights = ids[order], terms[order], weights[order]
    # a term that a point repeats is one entry
    fresh = np.flatnonzero(np.append(True, (np.diff(terms) != 0) | (np.diff(ids) != 0)))
    ids, terms, weights = ids[fresh], terms[fresh], np.add.reduceat(weights, fresh)
    starts = np.flatnonzero(np.append(True, np.diff(terms) != 0))
    sizes = np.diff(np.append(starts, len(terms)))
    pairs = pa.StructArray.from_arrays([pa.array(ids), pa.array(weights)], ["id", "weight"])
    columns = [
        pa.array(terms[starts]), pa.array(np.full(len(starts), ids.min())), pa.array(np.minimum.reduceat(weights, starts)),
        pa.array(np.maximum.reduceat(weights, starts)), pa.array(sizes.astype(np.int64)),
        pa.ListArray.from_arrays(pa.array(np.append(starts, len(terms)).astype(np.int32)), pairs),
    ]
    return pa.RecordBatch.from_arrays(columns, ["term", "cell", "least", "most", "size", "entries"])


def flat_entries(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Row, term and weight of the entries of a batch of vectors, without those that lack a term or a weight."""
    lists = batch.column("terms")
    rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    terms, weights = lists.flatten(), batch.column("weights").flatten()
    given = terms.is_valid().to_numpy(zero_copy_only=False) & weights.is_valid().to_numpy(zero_copy_only=False)
    terms, weights = terms.fill_null(0).to_numpy(), weights.fill_null(0).to_numpy().astype(np.float64)
    return rows[given], terms[given], weights[given]


def postings(points: DataFrame, cell: Column | None = None) -> Postings:
    """The index of the sparse vectors of ``points`` (``id, terms, weights``; ids are unique).

    ``cell`` says which points lie together, by default ``BLOCK`` consecutive
    ids each. Vectors are shuffled once, whole, and a task inverts them cell by
    cell; where a cell has more than ``ENTRIES`` entries it becomes several.
    """
    most = ENTRIES
    cell = F.expr(f"id div {BLOCK}") if cell is None else cell
    together = F.least(F.size("terms"), F.size("weights"))
    even = lambda x: F.when(F.size(x) == together, x).otherwise(F.slice(x, F.lit(1), together))
    weight = "array<float>" if dict(points.dtypes)["weights"] == "array<float>" else "array<double>"
    vectors = points.select(
        c("id").cast("long").alias("id"), cell.cast("long").alias("cell"),
        c("terms").cast("array<bigint>").alias("terms"), c("weights").cast(weight).alias("weights"),
    ).where("id is not null and cell is not null and terms is not null and weights is not null")
    vectors = vectors.select("id", "cell", even(c("terms")).alias("terms"), even(c("weights")).alias("weights"))

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            cells = b.column("cell").to_numpy()
            ids = b.column("id").to_numpy()
            rows, terms, weights = flat_entries(b)
            ends = np.searchsorted(rows, np.arange(b.num_rows), "right")  # of the entries of each row
            borders = np.append(np.flatnonzero(np.diff(cells)) + 1, b.num_rows)
            row = 0
            while row < b.num_rows:
                if cells[row] != last and held:
                    yield inverted(*map(np.concatenate, zip(*held, strict=True)))
                    held, count = [], 0
                last = cells[row]
                base = ends[row - 1] if row else 0
                # as many rows of this cell as there is room for, one at least if nothing is held
                stop = min(int(np.searchsorted(ends, base + most - count, "right")), int(borders[np.searchsorted(borders, row, "right")]))
                stop = max(stop, row if held else row + 1)
                if stop == row:
                    last = None  # full: the rest is a cell of its own
                elif ends[stop - 1] > base:
                    part = slice(base, ends[stop - 1])
                    held.append((ids[rows[part]], terms[part], weights[part]))
                    count += ends[stop - 1] - base
                row = stop
        if held:
            yield inverted(*map(np.concatenate, zip(*held, strict=True)))

    return Postings(stored(vectors.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(invert, LISTS), "postings"))


def sparse_search(index: Postings, queries: DataFrame, n: int, keep: DataFrame | None = None, digits: int = DIGITS) -> tuple[DataFrame, DataFrame]:
    """``qid, id, score, rank``: the ``n`` points of largest positive dot product with each query, and the visits.

    ``queries`` has ``qid, terms, weights``; ties go to the smaller id. With
    ``keep`` (``id``) only those points count. Weights may be negative.

    A task scores a cell for up to about ``QUERIES`` queries and hands on the
    ``n`` best of each, so what is shuffled are the lists and these.
    """
    asked = entries(queries, c("qid").cast("long").alias("qid")).groupBy("qid", "term").agg(F.sum("weight").alias("w"))
    asked = stored(asked, "asked")
    vectors = asked.groupBy("qid").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("weights"))
    shards = max(1, -(-vectors.count() // QUERIES))
    limits = index.lists.select("term", "cell", "least", "most", "size").join(small(asked), "term")
    most = F.greatest(c("w") * c("most"), c("w") * c("least"), F.lit(0.0))
    bounds = limits.groupBy("qid", "cell").agg(F.sum(most).alias("bound"), F.max("size").alias("size")).where("bound > 0")

    def run(lists: pa.Table, wanted: pa.Table) -> pa.Table:
        best = Best(len(wanted), n)
        if len(lists):
            lists = lists.sort_by("term")
            column = lists.column("entries").combine_chunks()
            known, starts, pairs = lists.column("term").to_numpy(), column.offsets.to_numpy(), column.values
            ids, at = np.unique(pairs.field("id").to_numpy(), return_inverse=True)
            values = pairs.field("weight").to_numpy()
            for q, (terms, weights) in enumerate(zip(wanted.column("terms"), wanted.column("weights"), strict=True)):
                terms = terms.values.to_numpy()
                lo = starts[np.searchsorted(known, terms, "left")]
                count = starts[np.searchsorted(known, terms, "right")] - lo
                each = np.arange(count.sum()) + np.repeat(lo - (np.cumsum(count) - count), count)
                total = np.bincount(at[each], values[each] * np.repeat(weights.values.to_numpy(), count), minlength=len(ids))
                score = np.round(total, digits)
                good = np.flatnonzero(score > 0)
                if len(good) > n:
                    good = good[score[good] >= np.partition(score[good], -n)[-n]]
                best.add_pairs(ids[good], np.full(len(good), q), score[good])
        qids = np.repeat(wanted.column("qid").to_numpy(), np.array([x.size for x in best.scores], np.int64))
        found = [np.concatenate([np.zeros(0, t), *x]) for t, x in ((np.int64, best.ids), (np.float64, best.scores))]
        return pa.table([pa.array(x) for x in (qids, *found)], names=["qid", "id", "score"])

    def score(cells: DataFrame) -> DataFrame:
        lists = index.lists.select("term", "cell", "entries").join(small(asked.select("term").distinct()), "term", "left_semi").join(
            small(cells.select("cell").distinct()), "cell", "left_semi")
        if keep is not None:
            kept = small(keep.select("id").distinct())
            lists = lists.select("term", "cell", F.explode("entries").alias("e")).withColumn("id", c("e.id")).join(
                kept, "id", "left_semi").groupBy("term", "cell").agg(F.collect_list("e").alias("entries"))
        lists = lists.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        wanted = cells.join(small(vectors), "qid").withColumn("shard", F.pmod(F.xxhash64("qid"), F.lit(shards)).cast("int"))
        left = lists.select("cell", "shard", "term", "entries").groupBy("cell", "shard")
        right = wanted.select("cell", "shard", "qid", "terms", "weights").groupBy("cell", "shard")
        return left.cogroup(right).applyInArrow(run, HIT)

    return settle(bounds, score, n, digits)


# ---- dense ------------------------------------------------------------------


def whole(dense: Column, dim: int) -> Column:
    """Whether a vector can be compared: of the length, without null, not-a-number and infinite parts."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(dense) == dim) & ~F.exists(dense, odd), F.lit(False))


def units(matrix: np.ndarray) -> np.ndarray:
    length = np.sqrt((matrix**2).sum(axis=1, keepdims=True))
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def matrix_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def pick_pivots(points: DataFrame, dim: int, pivots: int = 256, sample: int = 8192, rounds: int = 5) -> np.ndarray:
    """Unit vectors that cells are laid around, fitted to at most ``sample`` vectors drawn by the hash of their ids."""
    usable = points.where(whole(c("dense"), dim)).select("id", "dense")
    share = min(1.0, (2 * sample + 1000) / max(1, usable.count()))
    if share < 1:
        usable = usable.where(F.xxhash64("id") <= int(-(1 << 63) + share * (1 << 64)))
    rows = usable.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    found = units(matrix_of(rows.column("dense").combine_chunks(), dim))
    found = np.unique(found[(found != 0).any(axis=1)], axis=0)
    centres = found[np.linspace(0, len(found) - 1, min(pivots, len(found))).astype(int)] if len(found) else np.zeros((0, dim))
    for _ in range(rounds if len(centres) else 0):
        own = (found @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, found)
        centres = np.where((total != 0).any(axis=1, keepdims=True), units(total), centres)
    return centres


def cells(points: DataFrame, dim: int, pivots: int = 256, sample: int = 8192) -> Cells:
    """The index of the dense vectors of ``points`` (``id, dense``); vectors of another length and odd ones are left out.

    A point lies in the cell of the pivot with the smallest angle, a zero vector
    in a cell of its own.
    """
    centres = pick_pivots(points, dim, pivots, sample)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                unit = units(matrix_of(b.column("dense"), dim))
                zero = ~(unit != 0).any(axis=1)
                near = unit @ centres.T if len(centres) else np.zeros((len(unit), 1))
                own, at = near.argmax(axis=1), near.max(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(zero, -1, own).astype(np.int64)), b.column("id"), b.column("dense"), pa.array(np.clip(at, -1, 1))],
                    ["cell", "id", "dense", "at"])

    usable = points.where(whole(c("dense"), dim)).select(c("id").cast("long").alias("id"), c("dense").cast("array<double>").alias("dense"))
    placed = stored(usable.mapInArrow(assign, "cell long, id long, dense array<double>, at double"), "cells")
    summary = placed.groupBy("cell").agg(F.count("*").alias("size"), F.max("at").alias("near"), F.min("at").alias("far"))
    return Cells(placed.select("cell", "id", "dense"), stored(summary, "summary"), centres)


def cell_bounds(unit: np.ndarray, pivots: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The largest cosine that each query (a row) can have with a point of each cell."""
    angle = np.arccos(np.clip(unit @ pivots.T, -1, 1))
    inner, outer = np.arccos(np.clip(near, -1, 1)), np.arccos(np.clip(far, -1, 1))
    gap = np.maximum(0, np.maximum(angle - outer, inner - angle))
    return np.cos(np.maximum(0, gap - 1e-7))  # rounding errors of the angles are smaller


def dense_search(index: Cells, queries: DataFrame, n: int, keep: DataFrame | None = None, digits: int = DIGITS) -> tuple[DataFrame, DataFrame]:
    """``qid, id, score, rank``: the ``n`` points of largest cosine with each query, and the visits.

    ``queries`` has ``qid, dense``; queries of another length and odd ones have
    no hits, a zero vector scores zero. With ``keep`` (``id``) only those points
    count; ties go to the smaller id.
    """
    dim, pivots = index.pivots.shape[1], index.pivots
    asked = stored(queries.where(whole(c("dense"), dim)).select(
        c("qid").cast("long").alias("qid"), c("dense").cast("array<double>").alias("dense")), "asked")
    known = index.summary.orderBy("cell").collect()  # a row per pivot at most
    at = np.array([r["cell"] for r in known], np.int64)
    size = np.array([r["size"] for r in known], np.int64)
    near, far = (np.array([r[x] for r in known]) for x in ("near", "far"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = at >= 0
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                unit = units(matrix_of(part.column("dense"), dim))
                most = np.zeros((len(unit), len(at)))
                if around.any():
                    most[:, around] = cell_bounds(unit, pivots[at[around]], near[around], far[around])
                qid = np.repeat(part.column("qid").to_numpy(), len(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (qid, np.tile(at, len(unit)), most.ravel(), np.tile(size, len(unit)))], ["qid", "cell", "bound", "size"])

    def score(chosen: DataFrame) -> DataFrame:
        parts = index.summary.select("cell", F.ceil(c("size") / GROUP).alias("parts"))
        points = index.points if keep is None else index.points.join(small(keep.select("id").distinct()), "id", "left_semi")
        left = points.join(small(parts), "cell").join(small(chosen.select("cell").distinct()), "cell", "left_semi").select(
            "cell", F.pmod(F.xxhash64("id"), c("parts")).alias("part"), "id", "dense")
        right = chosen.join(small(parts), "cell").select("qid", "cell", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))
        right = right.join(small(asked), "qid")

        def run(points: pa.Table, wanted: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if len(points):
                matrix = matrix_of(points.column("dense").combine_chunks(), dim)
                ids = points.column("id").to_numpy()
                for i in range(0, len(wanted), 512):
                    block = QueryBlock([{**r, "terms": None, "weights": None} for r in wanted.slice(i, 512).to_pylist()])
                    best = Best(len(block.qids), n)
                    best.add(ids, np.round(block.cosine(matrix), digits), block.asked)
                    out += [(np.full(len(s), q), k, s) for q, k, s in zip(block.qids, best.ids, best.scores, strict=True)]
            columns = [np.concatenate([x[j] for x in out]) if out else np.zeros(0) for j in range(3)]
            return pa.table([pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int64)), pa.array(columns[2].astype(np.float64))], names=["qid", "id", "score"])

        return left.groupBy("cell", "part").cogroup(right.select("cell", "part", "qid", "dense").groupBy("cell", "part")).applyInArrow(run, HIT)

    return settle(asked.mapInArrow(bound, "qid long, cell long, bound double, size long"), score, n, digits)
