"""Approximate nearest neighbours: inverted lists scanned by adaptive dimension sampling.

Vectors are turned by one random rotation, so that any leading dimensions are a fair sample of a
distance. K-means centroids, fitted on a bounded sample, divide all rows into lists; a query probes
its nearest lists. Within a list the rotated vectors lie in column blocks. A query adds up squared
differences one column block at a time; after d of D dimensions a row is given up when its distance
scaled by sqrt(D / d) exceeds the current k-th best by more than the test's tolerance, a factor of
1 + EPSILON / sqrt(d). Rows that survive all blocks have exact distances, and those kept are
measured again on the original vectors in double precision. The k-th best starts as the k-th
distance among `PIVOTS` sample rows, so the tests work from the first row of every list on.

How many lists a query probes is set by measurement: sample rows are searched exactly and by lists,
and the least number of lists that reaches `RECALL` on the sample is taken; thinner samples have
farther neighbours, so the full table does no worse. Lists that hold too few rows are made up for
by probing further ones. The number of lists grows with the square root of the rows.

Vectors of each length are a search of their own: the lengths with rows for more than one list have
their centroids, all others one list, and all go through the same plan. Rows go to their list in
hash-dealt parts of at most about `BLOCK_ROWS`, so neither a large cluster nor a vector repeated in
a third of all rows falls to one task. Centroids and sample rows travel in the closure, bounded by
`SAMPLE_BYTES` for each length that has several lists; rotations are made where they are needed.

Defined edge cases: null, empty and zero vectors and ones with null or non-finite components take no
part; vectors of different lengths never meet; a null key takes no part; repeated rows are
candidates of their own, a repeated query key asks once, with its least vector; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, saved, table
from .vectors import BLOCK_ROWS, GROUP_QUERIES, best, finite, matrix

#: Rows and bytes of the sample for centroids and for measuring recall; queries measured; sample rows every query meets.
SAMPLE, SAMPLE_BYTES, MEASURED, PIVOTS = 65_536, 16 << 20, 256, 512
#: Rows a list should hold at least, sample rows for each list, dimensions that are rotated together.
LIST_ROWS, SAMPLE_PER_LIST, TURNED = 2048, 32, 1024
#: Recall that the sample must reach, tolerance of the hypothesis test, dimensions of a column block.
RECALL, EPSILON, COLUMNS = 0.97, 2.1, 16


@lru_cache(4)
def _rotation(dims: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    rng = np.random.default_rng(seed)
    order, parts = rng.permutation(dims), []
    for at in range(0, dims, TURNED):
        n = min(TURNED, dims - at)
        q, r = np.linalg.qr(rng.standard_normal((n, n)))
        parts.append(q * np.sign(np.diag(r)))
    return order, parts


def turned(x: np.ndarray, seed: int = 7) -> np.ndarray:
    """Rows under a random rotation of shuffled dimensions, `TURNED` of them at a time."""
    order, parts = _rotation(x.shape[1], seed)
    x = x[:, order]
    return np.concatenate([x[:, at : at + TURNED] @ q for at, q in zip(range(0, x.shape[1], TURNED), parts, strict=True)], axis=1)


@dataclass
class Index:
    """Of one length: centroids, lists that are probed, sample rows that every query meets, and their ids."""

    centres: np.ndarray
    probes: int
    pivots: np.ndarray
    ids: np.ndarray

    def near(self, x: np.ndarray) -> np.ndarray:
        return _squared(x, self.centres).argmin(1) if len(self.centres) > 1 else np.zeros(len(x), np.int64)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]


def kmeans(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        near = _squared(x, centres).argmin(1)
        count = np.bincount(near, minlength=lists)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def probes_needed(x: np.ndarray, centres: np.ndarray, k: int, recall: float = RECALL) -> int:
    """Lists that the sample's own queries must probe for `recall` of their k nearest."""
    if len(x) <= k + 1 or len(centres) == 1:
        return len(centres)
    lists = _squared(x, centres).argmin(1)
    queries = x[:: max(1, len(x) // MEASURED)]
    exact = np.argsort(_squared(queries, x), axis=1)[:, 1 : k + 1]
    order = np.argsort(_squared(queries, centres), axis=1)
    place = np.argsort(order, axis=1)  # when each list is probed
    at = np.take_along_axis(place, lists[exact], axis=1).ravel()
    return min(len(centres), int(np.quantile(at, recall, method="higher")) + 1)


class ColumnBlocks:
    """A part of a list: rotated vectors in column blocks, originals for the final measure."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        x = turned(self.rows)
        self.cuts = list(range(0, rows.shape[1], COLUMNS))
        self.blocks = [np.ascontiguousarray(x[:, c : c + COLUMNS]) for c in self.cuts]

    def search(self, query: np.ndarray, turned: np.ndarray, own: int, k: int, bar: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest found; nothing beyond the squared distance `bar` is wanted."""
        dims = len(query)
        kept_at, kept = np.zeros(0, np.int64), np.zeros(0)
        for start in range(0, len(self.ids), 1024):
            alive = np.arange(start, min(start + 1024, len(self.ids)))
            alive = alive[self.ids[alive] != own]
            partial = np.zeros(len(alive))
            for cut, block in zip(self.cuts, self.blocks, strict=True):
                diff = block[alive] - turned[cut : cut + COLUMNS]
                partial += np.einsum("ij,ij->i", diff, diff)
                read = min(cut + COLUMNS, dims)
                if read < dims and bar < math.inf:
                    stay = partial * (dims / read) <= bar * (1 + EPSILON / math.sqrt(read)) ** 2
                    alive, partial = alive[stay], partial[stay]
            kept_at, kept = np.concatenate([kept_at, alive]), np.concatenate([kept, partial])
            if len(kept) > k:
                top = np.lexsort((kept_at, kept))[: 2 * k + 8]  # places follow ids, so ties go to smaller ids
                kept_at, kept = kept_at[top], kept[top]
                bar = min(bar, kept[k - 1] * (1 + 1e-9))
        exact = np.sqrt(((self.rows[kept_at] - query) ** 2).sum(1))
        top = np.lexsort((self.ids[kept_at], exact))[:k]
        return self.ids[kept_at[top]], exact[top]


def search(vectors: DataFrame, queries: Column, k: int, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank, `key` and Euclidean distance of each query's k nearest found."""
    ready(vectors.sparkSession)
    rows = finite(vectors, vec, nonzero=True).where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("_id"), F.col(vec).cast("array<double>").alias("_v"), queries.alias("_q")
    )
    result = f"query_id long, `{key}` long, score double"
    rows = rows.withColumn("_d", F.size("_v"))
    totals = {r["_d"]: r["n"] for r in rows.groupBy("_d").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a length
    index = {d: _index(rows, d, n, k) for d, n in sorted(totals.items()) if n >= 2 * LIST_ROWS}

    def of(d: int) -> Index:
        return index.get(d) or Index(np.zeros((1, d)), 1, np.zeros((0, d)), np.zeros(0, np.int64))

    def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
        lengths = batch.column(2).to_numpy()
        for d in np.unique(lengths).tolist():
            yield d, batch.take(pa.array(np.flatnonzero(lengths == d)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part in by_length(batch):
                near = of(d).near(turned(matrix(pa.chunked_array([part.column(1)]))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32))], names=["_id", "_v", "_d", "_q", "_l"])

    placed = saved(rows.select("_id", "_v", "_d", "_q").mapInArrow(assign, "_id long, _v array<double>, _d int, _q boolean, _l int"))
    # one row a list, and one a length that has no other list
    sizes = placed.groupBy("_d", "_l").agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col("_q"), 1)).alias("_asked"))
    sizes = sizes.withColumn("_parts", F.ceil(F.col("_n") / BLOCK_ROWS).cast("int"))
    held: dict[int, np.ndarray] = {d: np.zeros(len(of(d).centres), np.int64) for d in totals}
    asked = dict.fromkeys(totals, 0)
    for r in sizes.collect():
        held[r["_d"]][r["_l"]] = r["_n"]
        asked[r["_d"]] += r["_asked"]
    groups = {d: max(1, math.ceil(asked[d] * of(d).probes / len(of(d).centres) / GROUP_QUERIES)) for d in totals}

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part in by_length(batch):
                for cut in range(0, part.num_rows, 64):
                    yield from _probed(part.slice(cut, 64), of(d), held[d], groups[d], k)

    many = F.create_map(*[F.lit(x) for d, g in groups.items() for x in (d, g)]) if groups else F.lit(None).cast("map<int,int>")
    split = placed.select("_id", "_v", "_d", "_l").join(F.broadcast(sizes.select("_d", "_l", "_parts")), ["_d", "_l"])  # one row a list
    left = split.withColumn("_p", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int")).drop("_parts").withColumn(
        "_g", F.explode(F.sequence(F.lit(0), many[F.col("_d")] - 1))
    )
    asked_once = placed.where("_q").groupBy("_id", "_d").agg(F.min("_v").alias("_v")).select("_id", "_v", "_d")
    right = asked_once.mapInArrow(probe, "_id long, _v array<double>, _d int, _bar double, _l int, _p int, _g int")

    def scan(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and queries.num_rows:
            part = ColumnBlocks(matrix(rows["_v"]), rows["_id"].to_numpy())
            asked = matrix(queries["_v"])
            for own, bar, q, t in zip(queries["_id"].to_pylist(), queries["_bar"].to_pylist(), asked, turned(asked), strict=True):
                ids, far = part.search(q, t, own, k, bar)
                out.append((np.full(len(ids), own, np.int64), ids, far))
        cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(3)]
        return pa.table({"query_id": cols[0].astype(np.int64), key: cols[1].astype(np.int64), "score": cols[2].astype(float)})

    by = ["_d", "_l", "_p", "_g"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(scan, result)
    return best(found, k, [F.asc("score"), F.asc(key)]).select("query_id", "rank", key, "score")


def _index(rows: DataFrame, dims: int, total: int, k: int) -> Index:
    """Centroids and probes of the `total` rows of one length, from a sample."""
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dims)))
    picked = rows.where(F.col("_d") == dims).orderBy(F.xxhash64("_id"), "_id", "_v").limit(most).select("_id", "_v").toArrow()
    sample, ids = turned(matrix(picked["_v"])), picked["_id"].to_numpy()
    lists = max(1, min(math.isqrt(total), total // LIST_ROWS, len(sample) // SAMPLE_PER_LIST))
    centres = kmeans(sample, lists)
    return Index(centres, probes_needed(sample, centres, k), sample[:PIVOTS], ids[:PIVOTS])


def _probed(part: pa.RecordBatch, index: Index, held: np.ndarray, groups: int, k: int) -> Iterator[pa.RecordBatch]:
    """One row for each query (_id, _v, _d) and each part of a list that it probes, with its first bar."""
    x, ids, lists = turned(matrix(pa.chunked_array([part.column(1)]))), part.column(0).to_numpy(), len(held)
    order = np.argsort(_squared(x, index.centres), axis=1) if lists > 1 else np.zeros((len(x), 1), np.int64)
    enough = np.cumsum(held[order], axis=1) > 4 * k
    upto = np.maximum(index.probes, np.where(enough.any(1), enough.argmax(1) + 1, lists))
    bars = np.full(len(x), np.inf)
    if len(index.pivots):
        far = np.maximum(_squared(x, index.pivots), 0)
        far[ids[:, None] == index.ids[None, :]] = np.inf
        if far.shape[1] > k:
            bars = np.partition(far, k - 1, axis=1)[:, k - 1] * (1 + 1e-6) + 1e-9
    parts = np.maximum(1, -(-held // BLOCK_ROWS))
    at = [(i, l, p) for i, n in enumerate(upto.tolist()) for l in order[i, :n].tolist() for p in range(parts[l])]
    own, l, p = (np.array(c, np.int32) for c in zip(*at, strict=True))
    for cut in range(0, len(own), 4096):
        i = own[cut : cut + 4096]
        columns = [part.column(c).take(pa.array(i)) for c in range(3)]
        group = (ids[i] % groups).astype(np.int32)
        more = [pa.array(bars[i]), pa.array(l[cut : cut + 4096]), pa.array(p[cut : cut + 4096]), pa.array(group)]
        yield pa.RecordBatch.from_arrays([*columns, *more], names=["_id", "_v", "_d", "_bar", "_l", "_p", "_g"])


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest neighbours found of every hundredth vector."""
    return search(table(ready(spark), sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)
