"""A stated set of query vectors against all vectors, in blocks.

Vectors and queries are dealt into blocks by a hash of their id, and each pair
of blocks is one task's work: every vector is sent to each query block, every
query to each vector block. Blocks have a bounded size, so memory does not
grow with the table, and nothing is broadcast or collected.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.store import stored

HITS = "query_id long, vec_id long, score {}"
Score = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def usable(df: DataFrame, vec_id: str, embedding: str, vector: Column | None = None) -> DataFrame:
    """``vec_id, vector`` of the rows that can take part.

    Left out: a null id, a null or empty vector, and vectors with a null, NaN
    or infinite component. Rows that repeat an id stay, each for itself.
    """
    number = F.col(embedding).cast("array<double>")
    fit = F.forall(number, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    rows = df.where(F.col(vec_id).isNotNull() & F.coalesce(F.size(embedding) > 0, F.lit(False)) & fit)
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), (number if vector is None else vector).alias("vector"))


def _matrix(table: pa.Table, kind) -> tuple[np.ndarray, np.ndarray]:
    ids = table["vec_id"].to_numpy()
    flat = pa.concat_arrays([x.flatten() for x in table["vector"].chunks]).to_numpy(zero_copy_only=False)
    return ids, flat.astype(kind, copy=False).reshape(len(ids), -1)


def nearest(
    vectors: DataFrame, query: Column, score: Score, k: int, ascending: bool, score_type: str,
    vector_block: int = 8192, query_block: int = 1024,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best vectors of each query.

    ``vectors`` is what :func:`usable` gives; ``query`` selects the queries
    among them. Only vectors of the same length meet. ``score`` gets ids and
    matrix of a vector block and of a query block and returns row numbers of
    queries, row numbers of vectors and scores of the ``k`` best per query of
    the block, none of the query's own id. Ties go to the smaller id; query
    rows of one id share a list.
    """
    vectors = stored(vectors.withColumn("dim", F.size("vector")), "vectors")
    sizes = vectors.agg(F.count("*"), F.count_if(query)).first()
    n_blocks, n_queries = max(1, math.ceil(sizes[0] / vector_block)), max(1, math.ceil(sizes[1] / query_block))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    points = vectors.select("vec_id", "vector", "dim", block(n_blocks).alias("vb"), every(n_queries).alias("qb"))
    asked = vectors.where(query).select("vec_id", "vector", "dim", block(n_queries).alias("qb"), every(n_blocks).alias("vb"))
    kind = np.int64 if score_type == "long" else np.float64

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            picked = (np.zeros(0, int), np.zeros(0, int), np.zeros(0, kind))
            ids = qids = np.zeros(0, np.int64)
        else:
            (ids, points), (qids, asked) = _matrix(left, kind), _matrix(right, kind)
            order = np.argsort(ids, kind="stable")
            ids, points = ids[order], points[order]
            picked = score(ids, points, qids, asked)
        return pa.table({"query_id": qids[picked[0]], "vec_id": ids[picked[1]], "score": picked[2].astype(kind)})

    keys = ("vb", "qb", "dim")
    hits = points.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, HITS.format(score_type))
    best = Window.partitionBy("query_id").orderBy(F.col("score").asc() if ascending else F.col("score").desc(), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
