"""Near duplicates by SimHash fingerprints and Golay-code fuzzy hashing.

Fingerprints: a text's ASCII letters are lowered, words are runs of other than blanks and
\\x09-\\x0D, shingles are `width` neighbouring words, repeats included; a bit of the fingerprint is 1
where it is set in over half of the shingles' XXH64 values.

Linking: two fingerprints within 4 bits must meet under a common key. A fingerprint is cut into
segments A and B of 23 bits and C of 18. The perfect binary Golay code maps any 23-bit word to the
one codeword within three bits; `near_codes` gives the codewords of a segment and of all its one-bit
changes, at most six, and two segments within two bits always share one of them. Errors (a, b, c)
with a + b + c <= 4 fall in one of these cases, each with its own composite key:
    a <= 2 and b <= 2        codes of A with codes of B
    b >= 3, so a + c <= 1    A itself with codes of C; codes of A with C itself
    a >= 3, so b + c <= 1    B itself with codes of C; codes of B with C itself
Rows are dealt by key and sorted; every pair that shares a key is verified by Hamming distance as
the sorted rows stream by. Only a spanning forest of each key's verified links is kept, so a dense
group of m fingerprints yields m - 1 links, not all pairs. A key held by more than `HELD`
fingerprints is not compared in one task: its members go to `ball_links`, an exact join on all
fingerprints within two bits, whose cost is linear in the members.

Copies share a fingerprint and are collapsed before any of this, with map-side aggregation.
Components come from alternating large-star and small-star steps over checkpointed edge tables.

Defined edge cases: null, empty and blank texts have fingerprint zero and link like any other; with
fewer words than `width`, the only shingle is the whole sequence; null keys keep their row and do
not name a component; repeated rows repeat in the result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, saved, table

WIDTH, DISTANCE, SEED = 4, 4, 42
#: Fingerprints under one key that a task compares by itself, and rows it gathers before it does.
HELD, GATHERED = 20_000, 100_000
#: Links of one partition while components are sought; links and roots up to which least neighbours are broadcast.
EDGES, SENT = 50_000, 500_000
#: The Golay code's generator polynomial: a fixed value.
GENERATOR = 0b110001110101


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The 64-bit SimHash of one text, as a signed integer."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    first = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    last = (ends[width - 1 :] if len(words) >= width else ends[-1:]).tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = slice(at, at + (1 << 16))
        hashes = [hash64(joined[s:e], SEED) for s, e in zip(first[part], last[part], strict=True)]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Key and `fp` (long) of every row."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), width) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, fp long")


# --- the Golay code -------------------------------------------------------------------------


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of the upper 12 bits of a word; error pattern of each syndrome."""
    upper = np.array([_remainder(m << 11) for m in range(1 << 12)], np.int64)
    errors = np.zeros(1 << 11, np.int64)
    ones = [1 << i for i in range(23)]
    for i, a in enumerate(ones):
        errors[_remainder(a)] = a
        for j, b in enumerate(ones[:i]):
            errors[_remainder(a ^ b)] = a ^ b
            for c in ones[:j]:
                errors[_remainder(a ^ b ^ c)] = a ^ b ^ c
    return upper, errors


_UPPER, _ERRORS = _tables()


def codewords() -> np.ndarray:
    """The 4096 codewords, each at the index that `decode` gives."""
    upper = np.arange(1 << 12)
    return upper << 11 | _UPPER


def decode(words: np.ndarray) -> np.ndarray:
    """Index (0 to 4095) of the codeword nearest to each 23-bit word."""
    return (words ^ _ERRORS[_UPPER[words >> 11] ^ (words & 0x7FF)]) >> 11


def near_codes(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each word and of its one-bit changes among the lower `bits`: sorted, and which are new."""
    changed = np.concatenate([[0], 1 << np.arange(bits)])
    codes = np.sort(decode(words[:, None] ^ changed[None, :]), axis=1)
    fresh = np.ones(codes.shape, bool)
    fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
    return codes, fresh


def _compact(codes: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """The new codes of each row moved to the left, padded by -1."""
    width = int(fresh.sum(axis=1).max()) if len(codes) else 1
    out = np.full((len(codes), width), -1, np.int64)
    row, col = np.nonzero(fresh)
    out[row, np.cumsum(fresh, axis=1)[row, col] - 1] = codes[row, col]
    return out


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (key, fingerprint) rows of an array of fingerprints."""
    u = fps.view(np.uint64)
    a, b, c = ((u >> np.uint64(s) & np.uint64(m)).astype(np.int64) for s, m in ((41, 0x7FFFFF), (18, 0x7FFFFF), (0, 0x3FFFF)))
    na, nb, nc = (_compact(*near_codes(x, n)) for x, n in ((a, 23), (b, 23), (c, 18)))
    keys, owners = [], []

    def add(kind: int, left: np.ndarray, right: np.ndarray, shift: int) -> None:
        key = (left[:, :, None] << shift) | right[:, None, :]
        ok = (left[:, :, None] >= 0) & (right[:, None, :] >= 0)
        keys.append((key | kind << 48)[ok])
        owners.append(np.broadcast_to(fps[:, None, None], ok.shape)[ok])

    add(0, na, nb, 12)
    add(1, a[:, None], nc, 12)
    add(2, na, c[:, None], 18)
    add(3, b[:, None], nc, 12)
    add(4, nb, c[:, None], 18)
    return np.concatenate(keys), np.concatenate(owners)


# --- links under a common key ---------------------------------------------------------------


def _far(x: np.ndarray, y: np.ndarray | np.int64) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64))


def forest(members: np.ndarray, distance: int = DISTANCE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest of all pairs within `distance`."""
    rest, links = members, []
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = _far(rest, x) <= distance
            if near.any():
                new, rest = rest[near], rest[~near]
                links.append((np.full(len(new), x), new))
                frontier.extend(new)
    return links


def _links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among sorted rows of complete keys."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    lengths = np.diff(np.append(starts, len(keys)))
    left, right = [], []
    for s, n in zip(starts[lengths > 12].tolist(), lengths[lengths > 12].tolist(), strict=True):
        for x, y in forest(np.unique(fps[s : s + n])):
            left.append(x)
            right.append(y)
    small = np.repeat((lengths > 1) & (lengths <= 12), lengths)
    k, f = keys[small], fps[small]
    for shift in range(1, 12):
        if len(k) <= shift:
            break
        hit = (k[shift:] == k[:-shift]) & (_far(f[shift:], f[:-shift]) <= DISTANCE) & (f[shift:] != f[:-shift])
        left.append(f[:-shift][hit])
        right.append(f[shift:][hit])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = np.concatenate(left), np.concatenate(right)
    pairs = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, v) for links, (u, null) for members of keys too large for one task."""
    held_k: list[np.ndarray] = []
    held_f: list[np.ndarray] = []
    over: int | None = None  # a key already found too large

    def rows(u: np.ndarray, v: np.ndarray | None) -> pa.RecordBatch:
        right = pa.array(v) if v is not None else pa.nulls(len(u), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(u), right], names=["u", "v"])

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held_k, held_f, over
        k, f = np.concatenate(held_k), np.concatenate(held_f)
        if over is not None:
            n = int(np.searchsorted(k, over, "right"))
            if n:
                yield rows(f[:n], None)
            k, f = k[n:], f[n:]
        cut = len(k) if last or not len(k) else int(np.searchsorted(k, k[-1]))
        if cut:
            yield rows(*_links(k[:cut], f[:cut]))
        k, f = k[cut:], f[cut:]
        if len(k) > HELD:
            over = int(k[-1])
            yield rows(f, None)
            k, f = k[:0], f[:0]
        held_k, held_f = [k], [f]

    for batch in batches:
        held_k.append(batch.column(0).to_numpy())
        held_f.append(batch.column(1).to_numpy())
        if sum(map(len, held_k)) >= GATHERED:
            yield from flush(False)
    if held_k:
        yield from flush(True)


def ball_links(members: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Exact links (u, v) of fingerprints `u` that share a point within distance/2 bits."""
    if distance != 4:
        raise ValueError("written for four bits")
    ones = [1 << i for i in range(64)]
    masks = [0, *ones, *(a | b for i, a in enumerate(ones) for b in ones[:i])]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    points = members.select("u", F.explode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("_m"))
    points = points.select("u", F.col("u").bitwiseXOR(F.col("_m")).alias("_z"))
    least = points.groupBy("_z").agg(F.min("u").alias("v"))
    return points.join(least, "_z").where("u <> v").select("u", "v").distinct()


def link(fps: DataFrame) -> DataFrame:
    """Links (u, v), u > v, whose components are those of all pairs of `fp` within four bits."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, f = keys_of(batch.column(0).to_numpy())
            for at in range(0, len(k), 20_000):
                cut = slice(at, at + 20_000)
                yield pa.RecordBatch.from_arrays([pa.array(k[cut]), pa.array(f[cut])], names=["k", "f"])

    keyed = fps.select("fp").mapInArrow(expand, "k long, f long")
    found = saved(keyed.repartition("k").sortWithinPartitions("k").mapInArrow(_stream, "u long, v long").distinct())
    links = found.where("v IS NOT NULL")
    large = found.where("v IS NULL").select("u").distinct()
    if large.isEmpty():
        return links
    return links.unionByName(ball_links(large)).distinct()


def components(links: DataFrame) -> DataFrame:
    """(fp, root) for every end of a link: root is the least fp that can be reached."""
    edges = saved(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        few = -(-mark[0] // EDGES)  # the loop shuffles as many files as the links fill, not as the session has partitions
        edges = edges.coalesce(few)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a hub's links lie in many partitions: its least neighbour goes to them, not they to it
        sent = F.broadcast if mark[0] <= SENT else lambda df: df
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        wide = both.join(sent(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = wide.groupBy("u").agg(F.min("v").alias("m"))
        narrow = wide.join(sent(low), "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(narrow.unionByName(low.select("u", F.col("m").alias("v"))).distinct().coalesce(few))
    roots = edges.select(F.col("u").alias("fp"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())


def cluster(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per input row: key, fp (long) and component_id, the least key that links reach."""
    prints = saved(fingerprints(docs, key, text, width))
    firsts = saved(prints.groupBy("fp").agg(F.min(key).alias("_first")))
    member = components(link(firsts))
    named = firsts.join(member, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # fingerprints alone under their root keep their own first key
    least = saved(named.groupBy("root").agg(F.min("_first").alias("_least"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("root", "_least"))
    least = F.broadcast(least) if least.limit(SENT + 1).count() <= SENT else least
    lookup = saved(named.join(least, "root", "left").select("fp", F.coalesce("_least", "_first").alias("component_id")))
    return prints.join(lookup, "fp").select(key, "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the component of near duplicates it belongs to."""
    out = cluster(table(ready(spark), sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
