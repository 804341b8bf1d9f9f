"""Nearest neighbours by a block matrix join: int8 product tiles with error bounds, then exact distances."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale of each row, length of what rounding took from each row)."""
    scale = np.abs(x).max(1, initial=0) / 127
    scale[scale == 0] = 1
    codes = np.rint(x / scale[:, None])
    return codes.astype(np.int8), scale, np.sqrt(((x - codes * scale[:, None]) ** 2).sum(1))


def tile(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Products of two blocks of int8 codes, exact: sums of at most 1,000 products of int8 fit float32's 24 bits."""
    out = np.zeros((len(q), len(c)))
    for d in range(0, q.shape[1], 1000):
        out += q[:, d : d + 1000].astype(np.float32) @ c[:, d : d + 1000].astype(np.float32).T
    return out


def exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, summed component by component in order.

    Where squares would overflow or vanish the differences are scaled by a power of two before, which is exact. A
    difference that is itself beyond a double counts as infinite.
    """
    steps = rows - query
    most = np.abs(steps).max(1, initial=0)
    odd = ((most > 1e140) | (most < 1e-140)) & (most > 0) & (most < np.inf)
    power = np.where(odd, -np.frexp(most)[1], 0)
    total = np.zeros(len(rows))
    for d in range(len(query)):
        step = np.ldexp(steps[:, d], power) if odd.any() else steps[:, d]
        total += step * step
    return np.ldexp(np.sqrt(total), -power) if odd.any() else np.sqrt(total)


class Tiles:
    """Blocks of queries against blocks of candidates, with the k best of each query kept in a heap."""

    def __init__(self, k: int) -> None:
        self.k, self.heaps = k, {}

    def add(self, qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray) -> None:
        if len(np.unique(cid)) < len(cid):  # a row that is repeated must not stand for several of the k best
            first = list({(i, v.tobytes()): at for at, (i, v) in reversed([*enumerate(zip(cid.tolist(), c, strict=True))])}.values())
            cid, c = cid[first], c[first]
        with np.errstate(over="ignore", invalid="ignore"):
            self.compare(qid, q, cid, c)

    def compare(self, qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray) -> None:
        qi, qs, qe = quantised(q)
        ci, cs, ce = quantised(c)
        q2, c2 = ((qi.astype(np.float64) * qs[:, None]) ** 2).sum(1), ((ci.astype(np.float64) * cs[:, None]) ** 2).sum(1)
        near = np.sqrt(np.maximum(q2[:, None] + c2[None] - 2 * tile(qi, ci) * qs[:, None] * cs[None], 0))
        # the true distance lies within the two rounding lengths of the quantised one; slack covers float64 rounding
        slack = 1e-6 * (1 + np.sqrt(q2[:, None] + c2[None]))
        error = qe[:, None] + ce[None] + slack
        low, high = near - error, near + error
        # of huge vectors the bounds overflow: such pairs are all computed
        low[~np.isfinite(low) | ~np.isfinite(high)] = -np.inf
        high[~np.isfinite(high) | np.isinf(low)] = np.inf
        own = qid[:, None] == cid[None]
        high[own] = np.inf
        k = min(self.k, high.shape[1])
        bound = np.partition(high, k - 1, axis=1)[:, k - 1] if high.shape[1] >= self.k else np.full(len(q), np.inf)
        for i, query in enumerate(qid.tolist()):
            heap = self.heaps.setdefault(query, [])
            most = min(bound[i], -heap[0][0]) if len(heap) == self.k else bound[i]
            alive = np.flatnonzero((low[i] <= most) & ~own[i])
            for score, other in zip(exact(q[i], c[alive]).tolist(), cid[alive].tolist(), strict=True):
                item = (-score, -other)
                if item in heap:
                    continue
                if len(heap) < self.k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)

    def result(self) -> pd.DataFrame:
        rows = [(q, -v, -s) for q, heap in self.heaps.items() for s, v in heap]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector of doubles): rows with an id whose vector is not null, zero or empty and has finite components only."""
    v = F.col(vector_col).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(whole, F.lit(False)))


def blocks_of(rows: DataFrame, size: int) -> DataFrame:
    """(dims, ids, data): rows packed into blocks of at most `size` vectors of the same length; no shuffle."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            flat = batch.column(1).flatten().to_numpy()
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            for dims in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == dims)
                for at in range(0, len(mine), size):
                    part = mine[at : at + size]
                    data = flat[starts[part][:, None] + np.arange(dims)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dims], pa.int32()), pa.array([ids[part].astype("<i8").tobytes()], pa.binary()), pa.array([data.astype("<f8").tobytes()], pa.binary())], ["dims", "ids", "data"]
                    )

    return map_batches(rows, task, "dims int, ids binary, data binary")


def nearest(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 100,
    k: int = 10,
    block: int = 2048,
    cell_bytes: int = 32 << 20,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of every query by Euclidean distance, exactly.

    Queries are the rows whose id is divisible by `every`; candidates are all rows but the query's own id. Both are
    packed into blocks, the blocks are dealt into strips of candidates and groups of queries of about cell_bytes each,
    by their counted bytes, and every strip meets every group in a cell: the stated query set against all rows, in
    blocks. A cell's blocks are sent to it once. Its task multiplies int8 codes tile by tile (as float32 numbers, whose
    24 bits hold the sums exactly). The quantised distance and the two vectors' rounding errors bound the true one from
    both sides, so only pairs whose lower bound is within the k-th upper bound are computed in double precision; a heap
    per query keeps the cell's k best, and of all cells' bests the k first are taken. Nothing is approximated and no
    pair is dropped unseen.

    Vectors null, empty, all zero or with null or non-finite components take no part, nor do null ids. Vectors of
    different lengths are not compared. Ties go to the smaller id; a row repeated with the same vector is one
    candidate. Rows of one query id with different vectors are one query, near to what is near to any of them. An empty
    table gives no rows. Other columns are not read.
    """
    rows = usable(vectors, id_col, vector_col)
    of_query = F.pmod("id", F.lit(every)) == 0
    size = F.size("v").cast("long") * 8
    n_bytes, n_query = rows.agg(F.sum(size), F.sum(F.when(of_query, size))).first()
    strips, groups = (max(1, -(-(n or 0) // cell_bytes)) for n in (n_bytes, n_query))
    strips = max(strips, rows.sparkSession.sparkContext.defaultParallelism) if n_bytes and n_bytes > cell_bytes // 8 else strips
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    candidates = blocks_of(rows, block).withColumn("strip", F.pmod(F.xxhash64("ids"), F.lit(strips))).withColumn("part", each(groups))
    queries = blocks_of(rows.filter(of_query), block).withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(groups))).withColumn("strip", each(strips))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        tiles = Tiles(k)
        for d, q_ids, q_data in zip(right["dims"], right["ids"], right["data"], strict=True):
            for e, ids, data in zip(left["dims"], left["ids"], left["data"], strict=True):
                if d == e:
                    tiles.add(np.frombuffer(q_ids, "<i8"), np.frombuffer(q_data, "<f8").reshape(-1, d), np.frombuffer(ids, "<i8"), np.frombuffer(data, "<f8").reshape(-1, d))
        return tiles.result()

    found = candidates.groupBy("strip", "part").cogroup(queries.groupBy("strip", "part")).applyInPandas(cell, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.distinct().withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


NEAREST_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    sqrt(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (c.e[i] - q.e[i]) * (c.e[i] - q.e[i])))) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score FROM d
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
