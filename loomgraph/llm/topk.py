"""Exact top-k inner products by sorted lists without random access.

The rows are cut into blocks by a hash of their key. A block sorts its rows once by each dimension:
one list of (row, component) a dimension, shared by all queries. A query reads a list from its high
end where its own component is positive and from its low end where it is negative, so what comes
next in a list never adds more than what came before. All lists are read in step, in growing depths.
For each row seen, the sum of what was read, with the last values read in place of the rest, bounds
its score from above, and with the lists' far ends from below; a row not seen yet is bounded by the
last values of all lists. Reading stops once fewer than `few` rows, seen or unseen, can reach the
bar: the k-th best lower bound, or the k-th best score among `SAMPLE` rows that every query is
compared with beforehand, whichever is more. Ties with the bar stay candidates. Only then are whole
rows looked up, and the candidates' scores resolved. Blocks are merged by a window that keeps k rows
of each query.

Queries meet the rows block by block: rows go to each group of queries and queries to each block,
so a task holds one block and one group, whatever the table's size; no key decides the dealing, so
none can be hot.

Defined edge cases: null or empty vectors and ones with null or non-finite components take no part,
neither as queries nor as rows; vectors of different lengths never meet; a null key never queries
and is never a candidate; repeated rows are candidates of their own, a
repeated query key asks once, with its least vector; a query's own key is excluded.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, table
from .vectors import BLOCK_ROWS, GROUP_QUERIES, best, finite, matrix

#: Share of a list that is read first, rows and components of a block, queries of a group, rows and bytes compared beforehand.
FIRST, ROWS, HELD, GROUP, SAMPLE, SAMPLE_BYTES = 1 / 8, 2 * BLOCK_ROWS, 2 << 20, GROUP_QUERIES, 1024, 8 << 20
#: Queries whose bounds are worked out together.
TOGETHER = 64


class Lists:
    """A block's rows in order of their ids, and one list sorted by each dimension."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.order = np.ascontiguousarray(np.argsort(self.rows, axis=0, kind="stable").T.astype(np.int32))
        self.values = np.take_along_axis(self.rows.T, self.order, axis=1).astype(np.float64)
        self.depths: list[int] = []  # how far the lists were read for each query

    def search(self, queries: np.ndarray, owns: list[int], bars: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (ids, scores) of the k best rows, best first, smaller id first among equals.

        Each list is read from both its ends, a slice at a time, into a matrix of what was read; a
        query takes the high ends of the lists where it is positive, the low ends elsewhere.
        """
        dims, n = self.values.shape
        q = queries.astype(np.float64)
        sides = np.maximum(q, 0), np.minimum(q, 0)
        bars, few = bars.copy(), max(8 * k, n // 64)
        mine = [slice(*np.searchsorted(self.ids, [own, own + 1])) for own in owns]
        read = np.zeros((2, n, dims))
        seen = np.zeros((2, n, dims), np.float32)
        found: list[tuple[np.ndarray, np.ndarray]] = [(self.ids[:0], self.ids[:0])] * len(q)
        at, depth, active = 0, max(k, int(n * FIRST)), np.arange(len(q))
        while len(active):
            upto = min(n, depth)
            for side, new in enumerate((slice(n - upto, n - at), slice(at, upto))):
                for d in range(dims):
                    rows = self.order[d, new]
                    read[side, rows, d] = self.values[d, new]
                    seen[side, rows, d] = 1
            last = self.values[:, n - upto], self.values[:, upto - 1]
            ends = self.values[:, 0], self.values[:, -1]
            left = []
            for cut in range(0, len(active), TOGETHER):
                some = active[cut : cut + TOGETHER]
                w = [side[some] for side in sides]
                low = most = read[0] @ w[0].T + read[1] @ w[1].T
                if upto < n:
                    unread = lambda v, w=w: sum((x * y).sum(1) - m @ (x * y).T for x, y, m in zip(w, v, seen, strict=True))
                    low, most = low + unread(ends), most + unread(last)
                for i, query in enumerate(some.tolist()):
                    low[mine[query], i] = most[mine[query], i] = -np.inf
                if n >= k:
                    bars[some] = np.maximum(bars[some], np.partition(low, n - k, axis=0)[n - k])
                hits = most >= bars[some] - 1e-6 * (1 + np.where(np.isfinite(bars[some]), np.abs(bars[some]), 0))
                done = (hits.sum(axis=0) <= few) | (upto == n)
                for i in np.flatnonzero(done).tolist():
                    query = int(some[i])
                    free = np.ones(n, bool)
                    free[mine[query]] = False
                    found[query] = self._resolved(np.flatnonzero(hits[:, i] & free), queries[query], k)
                    self.depths.append(upto)
                left.append(some[~done])
            active, at, depth = np.concatenate(left), upto, upto * 2
        return found

    def _resolved(self, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The candidates' whole rows are looked up here, and only here."""
        scores = self.rows[rows] @ query
        top = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[top]], scores[top]


def top_k(vectors: DataFrame, queries: Column, k: int, key: str = "vec_id", vec: str = "codes") -> DataFrame:
    """query_id, rank, `key` and score for each row under `queries`, over integer vectors `vec`."""
    ready(vectors.sparkSession)
    rows = vectors.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("_id"), F.col(vec).cast("array<long>").alias("_v"), queries.alias("_q")
    ).withColumn("_d", F.size("_v"))
    size = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("_q"), 1)), F.max("_d")).first()
    blocks = max(1, math.ceil(size[0] / max(64, min(ROWS, HELD // (size[2] or 1)))))
    groups = max(1, math.ceil(size[1] / GROUP))
    few = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * (size[2] or 1))))
    some = rows.groupBy("_id", "_d").agg(F.min("_v").alias("_v")).orderBy(F.xxhash64("_id"), "_id", "_d").limit(few).toArrow()
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by length: ids and vectors of at most SAMPLE rows
    for d in set(some["_d"].to_pylist()):
        part = some.filter(pa.compute.equal(some["_d"], d))
        known[d] = part["_id"].to_numpy(), matrix(part["_v"], np.int64)
    deal = lambda n: F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("_id", "_v", "_d", deal(blocks).alias("_b")).withColumn("_g", each(groups))
    right = (
        rows.where("_q").groupBy("_id", "_d").agg(F.min("_v").alias("_v"))
        .select("_id", "_v", "_d", deal(groups).alias("_g")).withColumn("_b", each(blocks))
    )

    def scan(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if rows.num_rows and queries.num_rows:
            lists = Lists(matrix(rows["_v"], np.int64), rows["_id"].to_numpy())
            owns, asked = queries["_id"].to_pylist(), matrix(queries["_v"], np.int64)
            bars = np.full(len(owns), -np.inf)
            if asked.shape[1] in known:
                ids, vectors = known[asked.shape[1]]
                scores = (asked @ vectors.T).astype(float)
                scores[np.array(owns)[:, None] == ids[None, :]] = -np.inf
                if len(ids) >= k:
                    bars = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
            for own, (ids, scores) in zip(owns, lists.search(asked, owns, bars, k), strict=True):
                out.append((np.full(len(ids), own, np.int64), ids, scores))
        cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3)]
        return pa.table({"query_id": cols[0], key: cols[1], "score": cols[2]})

    by = ["_b", "_g", "_d"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(scan, f"query_id long, `{key}` long, score long")
    ranked = best(found, k, [F.desc("score"), F.asc(key)])
    return ranked.select("query_id", "rank", key, "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector with all others."""
    vectors = finite(table(ready(spark), sf_dir, "embeddings"))
    coded = vectors.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("codes"))
    return top_k(coded, F.col("vec_id") % 50 == 0, 5)


def oracle() -> str:
    return """
WITH coded AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS codes FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.codes, c.codes)::BIGINT AS score
  FROM coded q JOIN coded c ON q.vec_id <> c.vec_id AND len(q.codes) = len(c.codes)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""
