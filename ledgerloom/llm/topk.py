"""Exact top-k inner products by a Voronoi kNN join.

Vectors are grouped by their nearest pivot. Each group's summary holds its
pivot, its members' largest distance from it, their number, and the distances of
its members nearest to it. With a query q, a pivot c and a member v at distance d,
q.v lies between q.c - |q|d and q.c + |q|d. So the summaries give each query a
floor under its k-th best score, and the groups that can reach that floor. Only
to those groups (in blocks of bounded size) is the query sent; each block is
solved by one matrix product and the best k of all blocks are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, materialize, table

#: Pivots at most, and rows of a block.
PIVOTS, BLOCK = 256, 20_000
_LIMIT = 2.0**52


def _matrix(column, dim: int) -> np.ndarray:
    """Lists of whole numbers (as doubles) as a matrix, short ones filled with zeros."""
    n = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), dim))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products, held within the range of long."""
    worst = (np.abs(q).max(initial=0) + 1) * (np.abs(v).max(initial=0) + 1) * q.shape[1]
    if worst < _LIMIT:
        return (q @ v.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in q], object).reshape(q.shape) @ np.array([[int(x) for x in r] for r in v], object).reshape(v.shape).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k best candidates, ties to the smaller id, without the query itself."""
    ok = np.flatnonzero(ids != own)
    if len(ok) > k:
        least = np.partition(scores[ok], len(ok) - k)[len(ok) - k]
        ok = ok[scores[ok] >= least]
    return ok[np.lexsort((ids[ok], -scores[ok]))][:k]


def _assign(pivots: np.ndarray, dim: int):
    norms = (pivots**2).sum(1)

    def run(batches):
        for batch in batches:
            v = _matrix(batch.column(1), dim)
            if not len(v):
                continue
            near = np.argmin(norms - 2 * (v @ pivots.T), axis=1)
            dist = np.sqrt(((v - pivots[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int32()), pa.array(dist, pa.float64())], names=["id", "vec", "cell", "dist"])

    return run


def _route(pivots: np.ndarray, radius: np.ndarray, nearest: list[np.ndarray], blocks: np.ndarray, k: int, dim: int):
    """Send each query to the blocks of all cells that can hold one of its k best."""

    def run(batches):
        cells = np.flatnonzero(blocks)
        of = np.concatenate([np.full(len(nearest[c]), c) for c in cells])
        dist = np.concatenate([nearest[c] for c in cells])
        for batch in batches:
            q = _matrix(batch.column(1), dim)
            if not len(q):
                continue
            norm = np.sqrt((q**2).sum(1))[:, None]
            to = q @ pivots.T
            slack = 1e-9 * (np.abs(to).max() + norm * (np.abs(dist).max(initial=0) + radius.max()) + 1)
            low = to[:, of] - norm * dist - slack
            # one place more, as the query itself may be among them
            floor = np.partition(low, low.shape[1] - k - 1, axis=1)[:, low.shape[1] - k - 1] if low.shape[1] > k else np.full(len(q), -np.inf)
            row, cell = np.nonzero(to[:, cells] + norm * radius[cells] + slack >= floor[:, None])
            cell = cells[cell]
            times = blocks[cell]
            row, cell = np.repeat(row, times), np.repeat(cell, times)
            block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            for a in range(0, len(row), 20_000):
                r = row[a : a + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(cell[a : a + 20_000], pa.int32()), pa.array(block[a : a + 20_000], pa.int32()), pa.array(np.ones(len(r)), pa.int32()), batch.column(0).take(pa.array(r)), batch.column(1).take(pa.array(r))], names=["cell", "block", "kind", "id", "vec"])

    return run


def _solve(k: int, dim: int):
    def run(batches):
        at, held, ids, v = None, [], None, None
        for batch in batches:
            cell, block, kind = (batch.column(i).to_numpy() for i in range(3))
            own, m = batch.column(3).to_numpy(), None
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(cell) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)])) if len(cell) else []
            out = []
            for a, b in zip(starts, [*starts[1:], len(cell)], strict=True):
                m = _matrix(batch.column(4).slice(a, b - a), dim)
                if (cell[a], block[a]) != at:
                    at, held, ids = (cell[a], block[a]), [], None
                if kind[a] == 0:
                    held.append((own[a:b], m))
                    continue
                if not held:
                    continue
                if ids is None:
                    ids, v = (np.concatenate(x) for x in zip(*held, strict=True))
                for c in range(0, len(m), 256):
                    scores = _products(m[c : c + 256], v)
                    for q, s in zip(own[a + c : a + c + len(scores)], scores, strict=True):
                        best = _best(s, ids, q, k)
                        out.append((np.full(len(best), q), ids[best], s[best]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0) -> DataFrame:
    """The k rows with the highest inner product for every row where ``is_query`` holds:
    query_id, rank (from 1), vec_id, score.

    Components become floor(scale * x); scores are exact whole numbers (held at the ends of long).
    Null vectors, those with null or non-finite components, and null ids take no part; shorter
    vectors count as filled with zeros, empty ones as zero. A row is never its own neighbour, nor
    is a repeated row of the same id; a repeated query or row gives its result once. Ties go to the
    smaller id; fewer rows than k give all. Other columns are passed over.
    """
    spark = vectors.sparkSession
    x = F.col(embedding)
    fine = x.isNotNull() & F.col(vec_id).isNotNull() & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    vecs = vectors.filter(fine).select(
        F.col(vec_id).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("vec"),
    ).dropDuplicates(["id"])
    vecs = materialize(vecs, "vectors")
    empty = "query_id long, rank int, vec_id long, score long"
    dim, rows = vecs.agg(F.max(F.size("vec")), F.count("*")).first()
    if not rows:
        return spark.createDataFrame([], empty)
    dim = max(1, dim)
    m = int(min(PIVOTS, max(1, rows**0.5)))
    chosen = vecs.select("vec").orderBy(F.xxhash64("id"), "id").limit(m).toArrow()
    pivots = np.unique(_matrix(chosen.column(0).combine_chunks(), dim), axis=0)
    cells = materialize(in_arrow(vecs.select("id", "vec"), _assign(pivots, dim), "id long, vec array<double>, cell int, dist double"), "cells")
    radius, blocks, nearest = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64), [np.zeros(0)] * len(pivots)
    for c, n, far in cells.groupBy("cell").agg(F.count("*"), F.max("dist")).collect():
        radius[c], blocks[c] = far, -(-n // BLOCK)
    # the k + 1 members of each cell nearest to its pivot: PIVOTS * (k + 1) numbers
    near = cells.select("cell", "dist", F.row_number().over(Window.partitionBy("cell").orderBy("dist", "id")).alias("r")).filter(F.col("r") <= k + 1)
    for c, ds in near.groupBy("cell").agg(F.collect_list("dist")).collect():
        nearest[c] = np.array(sorted(ds))
    count = F.lit(1)
    for c in np.flatnonzero(blocks > 1):
        count = F.when(F.col("cell") == int(c), F.lit(int(blocks[c]))).otherwise(count)
    names = "cell int, block int, kind int, id long, vec array<double>"
    data = cells.select("cell", F.pmod(F.xxhash64("id"), count).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "vec")
    queries = in_arrow(vecs.filter("query").select("id", "vec"), _route(pivots, radius, nearest, blocks, k, dim), names)
    dealt = data.unionByName(queries).repartition("cell", "block").sortWithinPartitions("cell", "block", "kind")
    found = in_arrow(dealt, _solve(k, dim), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark, sf_dir: str) -> DataFrame:
    """The five best neighbours of every fiftieth vector among all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES = {"op9_topk": op9_topk}
ORACLES = {"op9_topk": SQL}
