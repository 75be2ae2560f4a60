"""Exact top-k by inner product over vector-approximation files.

Vectors are integers, floor(1024 x) of each component.  A block of them has, beside the exact
vectors, an approximation: for each component the cell, one of CELLS equal ranges, that it lies in.
A scan of the cells bounds every score from below and above; the k-th best lower bound, or the k-th
exact score so far, rules out most rows; the others are read exactly, from the best bound
down, until no bound reaches the k-th score.

Queries go out in passes of a fixed number of bytes, whatever their number; within a pass each task
keeps k rows a query over all its blocks, so that only these are shuffled.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE, K, CELLS, BLOCK_ROWS = 1024, 10, 16, 4096
#: Bytes of query vectors in one pass, and queries compared with a block at once.
PASS_BYTES, QUERY_ROWS = 8_000_000, 256
#: At most this product of magnitudes and components is exact in doubles.
_EXACT = 2**52


def whole(df: DataFrame) -> DataFrame:
    """(vec_id, v array<long>): the rows that take part.  Null vectors, and ones with null or non-finite components, don't; nor do empty ones and null ids."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    doubles = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & doubles.isNotNull() & (F.size(doubles) > 0) & ~F.exists(doubles, bad)
    return df.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(doubles, lambda x: F.floor(x * SCALE)).alias("v"))


class Approximation:
    """Cells of a block of vectors, one byte a component."""

    def __init__(self, v: np.ndarray, cells: int = CELLS):
        self.low = v.min(0).astype(np.float64)
        self.width = np.floor((v.max(0) - self.low) / cells) + 1
        self.cell = np.floor((v - self.low) / self.width).astype(np.uint8)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of every score, queries by rows.  A cell holds low + cell * width up to width - 1 more."""
        base = (q * self.width) @ self.cell.T.astype(np.float64) + (q @ self.low)[:, None]
        reach = self.width - 1
        return base + (np.minimum(q, 0) @ reach)[:, None], base + (np.maximum(q, 0) @ reach)[:, None]


def _dot(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    if float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * len(q) < _EXACT:
        return (v.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(row, q)) for row in v], object).astype(np.int64)


class Best:
    """The k best rows of each query so far, by score and then the smaller id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.rows: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, vec_id), sorted

    def take(self, ids: np.ndarray, v: np.ndarray) -> None:
        near = Approximation(v)
        exact_bounds = float(np.abs(v).max(initial=0)) * float(np.abs(self.queries).max(initial=0)) * v.shape[1] < _EXACT
        for at in range(0, len(self.ids), QUERY_ROWS):
            own = self.queries[at : at + QUERY_ROWS]
            low, high = near.bounds(own.astype(np.float64))
            if not exact_bounds:  # beyond what doubles hold, every row is read
                low, high = np.full_like(low, -np.inf), np.full_like(high, np.inf)
            low[self.ids[at : at + QUERY_ROWS, None] == ids] = -np.inf  # the query's own rows don't count
            kth = np.partition(low, -self.k, 1)[:, -self.k] if low.shape[1] >= self.k else np.full(len(own), -np.inf)
            for i in range(len(own)):
                best = self.rows[at + i]
                floor = max(kth[i], -best[-1][0] if len(best) == self.k else -np.inf)
                rows = np.flatnonzero(high[i] >= floor)
                rows = rows[np.argsort(-high[i, rows], kind="stable")]
                for lo in range(0, len(rows), 64):
                    some = rows[lo : lo + 64]
                    if len(best) == self.k and high[i, some[0]] < -best[-1][0]:
                        break
                    scores = _dot(v[some], own[i])
                    best = sorted(best + [(-int(s), int(x)) for s, x in zip(scores, ids[some]) if x != self.ids[at + i]])[: self.k]
                self.rows[at + i] = best


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of vectors for every row of queries, all if there are fewer.

    Both have (vec_id, embedding); a query isn't compared with rows of its own vec_id, nor vectors
    of different lengths with each other.  Ties go to the smaller vec_id.  Repeated rows of vectors
    are rows of their own; repeated queries count once.  Rows that whole() leaves out take no part.
    """
    rows, wanted = whole(vectors), whole(queries).distinct()
    size = wanted.agg(F.coalesce(F.sum(8 + 8 * F.size("v")), F.lit(0)).alias("n")).first()["n"]
    passes = max(1, -(-size // PASS_BYTES))
    found = []
    for p in range(passes):
        few = wanted.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).collect()  # PASS_BYTES of vectors
        by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d in {len(r["v"]) for r in few}:
            own = sorted((r["vec_id"], r["v"]) for r in few if len(r["v"]) == d)
            by[d] = np.array([x for x, _ in own], np.int64), np.array([v for _, v in own], np.int64)

        def scan(batches, by=by):
            best = {d: Best(*q, k) for d, q in by.items()}
            held: dict[int, tuple[list, list]] = {d: ([], []) for d in by}

            def flush(d):
                ids, v = held[d]
                best[d].take(np.concatenate(ids), np.concatenate(v))
                held[d] = ([], [])

            for batch in batches:
                v = batch.column(1)
                flat, offsets = v.flatten().to_numpy(zero_copy_only=False), v.offsets.to_numpy()
                offsets = offsets - offsets[0]
                ids, sizes = batch.column(0).to_numpy(), np.diff(offsets)
                for d in set(sizes.tolist()) & set(by):
                    at = np.flatnonzero(sizes == d)
                    held[d][0].append(ids[at])
                    held[d][1].append(flat[offsets[at][:, None] + np.arange(d)])
                    if sum(map(len, held[d][0])) >= BLOCK_ROWS:
                        flush(d)
            for d in by:
                if held[d][0]:
                    flush(d)
                out = [(int(q), x, -s) for q, own in zip(best[d].ids, best[d].rows) for s, x in own]
                for lo in range(0, len(out), 100_000):
                    a, b, c = zip(*out[lo : lo + 100_000])
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["query_id", "vec_id", "score"])

        found.append(rows.mapInArrow(scan, "query_id long, vec_id long, score long"))
    every = reduce(DataFrame.unionByName, found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
