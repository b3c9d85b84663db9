"""Filtered hybrid search over a table of points.

A point is a passage row with ``id``, ``dense`` and the ``terms``/``weights`` of
its sparse vector. Queries come in batches: one scan of the points scores all of
them, and every task keeps only its best few per query, so what is shuffled
depends on the number of tasks and queries, never on the number of points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.config import DEFAULTS, Settings
from quire.functions import text as T
from quire.functions.frames import durable, small
from quire.functions.encoding import Encoder, HashingEncoder, vectors

CANDIDATE_TYPE = "branch string, qid bigint, id bigint, score double"


# ---- filters ----------------------------------------------------------------


def source_matches(source: Column, wanted: Column) -> Column:
    """Every word of ``wanted`` occurs among the words of ``source``."""
    have = T.tokens(F.coalesce(source, F.lit("")))
    return F.forall(T.tokens(wanted), lambda t: F.array_contains(have, t))


def payload_filter(
    points: DataFrame, book: str | None = None, kind: str | None = None, source: str | None = None
) -> DataFrame:
    """Conjunction of the given restrictions; equality ones reach the scan."""
    if book:
        points = points.filter(F.col("book") == book)
    if kind:
        points = points.filter(F.col("kind") == kind)
    if source:
        points = points.filter(source_matches(F.col("source"), F.lit(source)))
    return points


# ---- candidates -------------------------------------------------------------

# what a worker scores at once: points of the dense branch, shared terms of the sparse one
POINTS, MATCHES = 1024, 1 << 19


class Best:
    """The ``n`` best (score, id) pairs per query seen so far in one task."""

    def __init__(self, queries: int, n: int):
        self.n = n
        self.scores = [np.empty(0)] * queries
        self.ids = [np.empty(0, dtype=np.int64)] * queries
        self.floor = np.full(queries, -np.inf)

    def add(self, ids: np.ndarray, scores: np.ndarray, queries: np.ndarray) -> None:
        """``scores`` is points x queries; ties go to the smaller id."""
        good = scores >= self.floor[queries]
        for k in np.flatnonzero(good.any(axis=0)):
            rows = np.flatnonzero(good[:, k])
            self._keep(queries[k], ids[rows], scores[rows, k])

    def add_pairs(self, ids: np.ndarray, queries: np.ndarray, scores: np.ndarray) -> None:
        """Pairs in the order of their queries; only positive scores count."""
        good = (scores > 0) & (scores >= self.floor[queries])
        if not good.any():
            return
        ids, queries, scores = ids[good], queries[good], scores[good]
        cuts = np.flatnonzero(np.diff(queries, prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(queries)), strict=True):
            self._keep(queries[a], ids[a:b], scores[a:b])

    def _keep(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        s, i = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        if s.size > self.n:
            order = np.lexsort((i, -s))[: self.n]
            s, i = s[order], i[order]
            self.floor[q] = s[-1]
        self.scores[q], self.ids[q] = s, i


class QueryBlock:
    """Vectors of a bounded batch of queries, as arrays.

    A query without a dense vector, or with one of another length than the
    first, takes no part in the dense branch.
    """

    def __init__(self, rows: list):
        self.qids = np.array([r["qid"] for r in rows], dtype=np.int64)
        given = [(q, r["dense"]) for q, r in enumerate(rows) if r["dense"] and None not in r["dense"]]
        self.dim = len(given[0][1]) if given else 0
        given = [(q, d) for q, d in given if len(d) == self.dim]
        self.asked = np.array([q for q, _ in given], dtype=np.int64)
        self.dense = np.array([d for _, d in given], dtype=np.float64).reshape(len(given), self.dim)
        pairs = [
            (t, q, w)
            for q, r in enumerate(rows)
            for t, w in zip(r["terms"] or [], r["weights"] or [])
        ]
        pairs.sort()
        self.terms = np.array([p[0] for p in pairs], dtype=np.int64)
        self.owner = np.array([p[1] for p in pairs], dtype=np.int64)
        self.weight = np.array([p[2] for p in pairs], dtype=np.float64)

    def cosine(self, points: np.ndarray) -> np.ndarray:
        dot = points @ self.dense.T
        squares = np.outer((points**2).sum(axis=1), (self.dense**2).sum(axis=1))
        return np.divide(dot, np.sqrt(squares), out=np.zeros_like(dot), where=squares > 0)

    def parts(self, rows: np.ndarray, terms: np.ndarray) -> Iterator[slice]:
        """Runs of postings of whole points with about ``MATCHES`` shared terms in all, one point at least."""
        count = np.searchsorted(self.terms, terms, "right") - np.searchsorted(self.terms, terms, "left")
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        ends = np.append(starts[1:], len(rows))
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])[ends]
        k = 0
        while k < len(starts):
            base = total[k - 1] if k else 0
            last = max(k + 1, int(np.searchsorted(total, base + MATCHES, "right")))
            yield slice(starts[k], ends[last - 1])
            k = last

    def overlap(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
        """Point, query and dot product of the pairs that share a term, from postings (row, term, weight)."""
        lo = np.searchsorted(self.terms, terms, "left")
        count = np.searchsorted(self.terms, terms, "right") - lo
        hit = np.flatnonzero(count)
        lo, count = lo[hit], count[hit]
        # position of every matching query posting, one entry per match
        first = np.repeat(np.cumsum(count) - count, count)
        at = np.arange(first.size) - first + np.repeat(lo, count)
        key = self.owner[at] * (rows.max() + 1 if len(rows) else 1) + np.repeat(rows[hit], count)
        pair, where = np.unique(key, return_inverse=True)
        total = np.bincount(where, np.repeat(weights[hit], count) * self.weight[at], minlength=len(pair))
        query, row = np.divmod(pair, rows.max() + 1 if len(rows) else 1)
        return row, query, total


def _dense_rows(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and matrix of the vectors that are whole: not null, of the length asked for, all finite."""
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()), -1)
    at = np.flatnonzero(sizes == dim) if dim else np.zeros(0, np.int64)
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(at), dim)
    good = np.isfinite(matrix).all(axis=1)
    return at[good], matrix[good]


def _score_points(blocks, n: int, digits: int, dense: bool, sparse: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: list[QueryBlock] = blocks.value
        on = [name for name, used in (("dense", dense), ("sparse", sparse)) if used]
        best = [{b: Best(q.qids.size, n) for b in on} for q in queries]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            if sparse:
                lists = batch.column("terms")
                sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), 0)
                rows = np.repeat(np.arange(len(ids)), sizes)
                terms = lists.flatten().to_numpy(zero_copy_only=False)
                weights = batch.column("weights").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            for q, top in zip(queries, best, strict=True):
                if dense and q.dim:
                    at, matrix = _dense_rows(batch.column("dense"), q.dim)
                    for i in range(0, len(at), POINTS):
                        top["dense"].add(ids[at[i:i + POINTS]], np.round(q.cosine(matrix[i:i + POINTS]), digits), q.asked)
                if sparse:
                    for part in q.parts(rows, terms):
                        row, owner, total = q.overlap(rows[part], terms[part], weights[part])
                        top["sparse"].add_pairs(ids[row], owner, np.round(total, digits))
        for q, top in zip(queries, best, strict=True):
            for branch, found in top.items():
                sizes = [s.size for s in found.scores]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([branch] * sum(sizes), pa.string()),
                        pa.array(np.repeat(q.qids, sizes), pa.int64()),
                        pa.array(np.concatenate(found.ids), pa.int64()),
                        pa.array(np.concatenate(found.scores), pa.float64()),
                    ],
                    names=["branch", "qid", "id", "score"],
                )

    return run


def encode_queries(queries: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """``qid, dense, terms, weights`` of a ``qid, text`` table."""
    return queries.select("qid", vectors(F.col("text"), encoder or HashingEncoder()).alias("v")).select(
        "qid", "v.*"
    )


def nearest(
    points: DataFrame,
    query_vectors: DataFrame,
    n: int,
    dense: bool = True,
    sparse: bool = True,
    digits: int = 6,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """``branch, qid, id, score, rank``: the ``n`` best points of each query and branch.

    Exact. Queries are encoded once and shipped to the tasks, which go through
    them in blocks for every batch of points: one scan of the points, with the
    shuffle depending on tasks and queries only. More than ``query_pass`` of them
    take a further scan each time. Scores are rounded before ranking and ties go
    to the smaller id, so the order does not depend on the summation order.

    Points and queries without a dense vector, or with one of another length
    or with null or infinite parts, take no part in the dense branch.
    """
    spark = points.sparkSession
    columns = ["id"] + ["dense"] * dense + ["terms", "weights"] * sparse
    wanted = query_vectors.select(
        "qid",
        *(F.col("dense") if dense else F.lit(None).alias("dense"),),
        *((F.col("terms"), F.col("weights")) if sparse
          else (F.lit(None).alias("terms"), F.lit(None).alias("weights"))),
    )
    found = wanted.limit(settings.query_pass + 1).collect()
    if len(found) > settings.query_pass:
        wanted = durable(wanted)
        passes = -(-wanted.count() // settings.query_pass)
        shard = F.pmod(F.xxhash64("qid"), F.lit(passes))
        groups = (wanted.filter(shard == p).collect() for p in range(passes))
    else:
        groups = iter([found])
    merged = None
    for rows in groups:
        if not rows:
            continue
        size = settings.query_block
        shared = spark.sparkContext.broadcast([QueryBlock(rows[i:i + size]) for i in range(0, len(rows), size)])
        part = points.select(*columns).mapInArrow(_score_points(shared, n, digits, dense, sparse), CANDIDATE_TYPE)
        merged = part if merged is None else merged.unionAll(part)
    if merged is None:
        return spark.createDataFrame([], CANDIDATE_TYPE + ", rank int")
    order = Window.partitionBy("branch", "qid").orderBy(F.desc("score"), "id")
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def fuse(ranked: DataFrame, n: int, settings: Settings = DEFAULTS) -> DataFrame:
    """Reciprocal rank fusion: ``qid, id, score, rank``, the ``n`` best per query."""
    total = ranked.groupBy("qid", "id").agg(
        F.sum(F.lit(1.0) / (F.lit(settings.rrf_constant) + F.col("rank"))).alias("score")
    )
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return total.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


# ---- rerank -----------------------------------------------------------------


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text contains."""
    asked = F.array_distinct(T.tokens(query))
    found = F.array_intersect(asked, T.tokens(text))
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.size(found) / F.size(asked))


def rerank(
    hits: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = overlap_score
) -> DataFrame:
    """Reorder fused hits by ``scorer(query, text)``; equal scores keep their order."""
    scored = hits.withColumn("rerank_score", scorer(F.col("query"), F.col("text")).cast("double"))
    order = Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "rank")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# ---- the whole search -------------------------------------------------------


def search(
    points: DataFrame,
    queries: DataFrame,
    k: int = DEFAULTS.k,
    candidates: int = DEFAULTS.candidates,
    book: str | None = None,
    rerank_hits: bool = True,
    source: str | None = None,
    kind: str | None = None,
    encoder: Encoder | None = None,
    scorer: Callable[[Column, Column], Column] = overlap_score,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """The ``k`` best passages per query with payload, ``score`` and ``rank``.

    The filter works below both branches, so each still yields ``candidates``
    points. With reranking the fused list is as long and the scorer decides.
    """
    live = payload_filter(points, book, kind, source)
    texts = queries.select("qid", F.col("text").alias("query"))
    # fused lists hold at most ``candidates`` narrow rows per query, so their size
    # is known beforehand; as long as it is bounded the points' texts stay where they are
    most = settings.broadcast_rows // max(1, candidates)
    hint = F.broadcast if queries.limit(most + 1).count() <= most else (lambda df: df)
    ranked = nearest(live, encode_queries(queries, encoder), candidates, settings=settings)
    fused = fuse(ranked, candidates if rerank_hits else k, settings)
    hits = live.drop("dense", "terms", "weights").join(hint(fused), "id").join(small(texts), "qid")
    if rerank_hits:
        hits = rerank(hits, k, scorer)
    return hits


# ---- rendering --------------------------------------------------------------


def cite(
    book_title: Column, source: Column, section: Column, section_title: Column,
    page_start: Column, page_end: Column,
) -> Column:
    """Citation line: title, source, section and page range, empty parts left out."""

    def number(p: Column) -> Column:
        return F.coalesce(p.cast("string"), F.lit("None"))

    def given(c: Column) -> Column:
        return F.when(c != "", c)

    label = F.when(
        F.coalesce(section, F.lit("")) != "", F.concat(F.lit("S"), section, F.lit(" "), section_title)
    ).otherwise(section_title)
    pages = F.when(
        page_start.eqNullSafe(page_end), F.concat(F.lit("p."), number(page_start))
    ).otherwise(F.concat(F.lit("pp."), number(page_start), F.lit("-"), number(page_end)))
    return F.concat_ws(" | ", given(book_title), given(source), given(label), pages)


def cite_row() -> Column:
    return cite(*map(F.col, ("book_title", "source", "section", "section_title", "page_start", "page_end")))


def preview(text: Column, full: bool = False, settings: Settings = DEFAULTS) -> Column:
    """The text as a result list shows it: its beginning on one line."""
    if full:
        return text
    return F.concat(F.replace(F.left(text, F.lit(settings.preview_characters)), F.lit("\n"), F.lit(" ")), F.lit(" ..."))
