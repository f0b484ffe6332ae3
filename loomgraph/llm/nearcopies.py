"""Near duplicates at a wanted shingle similarity: SimHash, Golay codes as keys, exact verification.

`simhash.cluster` links fingerprints within four bits, which texts reach only when nearly equal. Here
texts count as near duplicates when the sets of their `WIDTH`-word shingles have a Jaccard similarity
of `SIMILARITY` or more; such fingerprints differ in up to a quarter of their bits.

Keys. A text's shingles vote on 256 bits: the shingles' XXH64 values and three mixtures of them. The
first 230 votes are ten segments of 23. A segment is decoded softly: of the Golay code's 4096 words
the `CODES` that agree best with the segment's votes are taken, so the bits that an edit turns, which
are those with close votes, hardly count. Two segments side by side make one key of 24 bits and five
pairs of segments `5 * CODES ** 2` keys a text; similar texts agree in both segments of at least one
pair (one of 20,000 measured pairs was missed by key, none once its group was verified). Keys propose
with high probability, not surely; whatever is linked is exact.

Join. Rows under one key that differ in at most `BITS` of 192 bits are linked, and a task keeps a
spanning forest of its links, so a dense group of m texts leaves some m links a key, not all pairs.
A key beyond `HELD` rows is dealt again as pairs of blocks: every row meets every other one.

Verification. The connected groups of these links are small; the texts of a group meet in one task,
each sent once, and all pairs not yet in one component are compared on their whole shingle sets. A
group beyond `BLOCK` texts (or `HASHES` shingles) is verified block by block, then by spread samples
of the components found, and what is then outside the group's largest component meets, block by
block, all of the group. Only pairs inside one component are never compared, so no link between
components is lost and a group of near copies costs a few comparisons a text. Results are links to
the least key of a component: nowhere is there a row for each pair.

Equal word sequences are collapsed before any of this.

Defined edge cases: texts without words are one group; with fewer words than `WIDTH` the only shingle
is the whole sequence; a null key names no component and is never dropped; rows repeated under one key
are kept or dropped together; an empty table gives an empty result; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, saved
from .simhash import SEED, codewords, components

WIDTH, SIMILARITY = 5, 0.8
#: Bits of a segment, segments, codewords of each that make keys.
SEGMENT, SEGMENTS, CODES = 23, 10, 5
#: Differing bits of 192 up to which rows are linked: 29 are usual at 0.8, 96 among strangers.
BITS = 57
#: Rows of a key compared as shifted columns, rows of one block of a larger key, rows gathered.
SMALL, HELD, GATHERED = 8, 20_000, 100_000
#: Texts and shingles of a block that is verified, texts that stand for a component of a large group.
BLOCK, HASHES, SAMPLE = 256, 2_000_000, 32
#: Rows up to which groups, and the texts to verify, are named by a broadcast; beyond, their other side is shuffled.
BROADCAST_ROWS = 300_000
#: Odd factors that mix a shingle's hash into further words.
FACTORS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def shingles(text: str | None, width: int = WIDTH) -> tuple[bytes, np.ndarray]:
    """The lower-case words joined by blanks, and the distinct hashes of their shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    if not words:
        return joined, np.zeros(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    first = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    last = (ends[width - 1 :] if len(words) >= width else ends[-1:]).tolist()
    hashes = np.fromiter((hash64(joined[s:e], SEED) for s, e in zip(first, last, strict=True)), np.uint64, n)
    return joined, np.unique(hashes)


def _mixed(h: np.ndarray, factor: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(factor)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(FACTORS[0])
    return h ^ (h >> np.uint64(32))


def votes(hashes: np.ndarray) -> np.ndarray:
    """For each of 256 bits, the shingles that have it less those that do not."""
    counts = np.zeros(256, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        words = np.stack([part, *(_mixed(part, f) for f in FACTORS)], axis=1).astype(">u8")
        counts += np.unpackbits(words.view(np.uint8).reshape(len(part), 32), axis=1).sum(axis=0, dtype=np.int32)
    return counts * 2 - len(hashes)


_WORDS: list[np.ndarray] = []


def codes_of(counts: np.ndarray) -> np.ndarray:
    """For texts' votes (text, 256) the codes (text, segment, CODES) that agree best with each segment."""
    if not _WORDS:  # the code's words as signs, made once a worker
        _WORDS.append((codewords()[None, :] >> np.arange(SEGMENT)[:, None] & 1).astype(np.float32) * 2 - 1)
    out = np.empty((len(counts) * SEGMENTS, CODES), "<u2")
    cut = counts[:, : SEGMENT * SEGMENTS].reshape(-1, SEGMENT).astype(np.float32)
    for at in range(0, len(cut), 640):
        agreed = cut[at : at + 640] @ _WORDS[0]
        rows = np.arange(len(agreed))
        for i in range(CODES):
            out[at : at + 640, i] = best = agreed.argmax(axis=1)
            agreed[rows, best] = -np.inf
    return out.reshape(len(counts), SEGMENTS, CODES)


def keys_of(codes: np.ndarray) -> np.ndarray:
    """The keys (text, 5 * CODES ** 2) of texts' codes: those of two neighbouring segments."""
    pairs = codes.astype(np.int32).reshape(len(codes), SEGMENTS // 2, 2, CODES)
    kind = np.arange(SEGMENTS // 2, dtype=np.int32)[None, :, None, None] << 24
    return (kind | pairs[:, :, 0, :, None] << 12 | pairs[:, :, 1, None, :]).reshape(len(codes), -1)


def node(fps: np.ndarray) -> np.ndarray:
    """One number for each fingerprint (row, 3)."""
    u = fps.view(np.uint64)
    return (_mixed(u[:, 0], FACTORS[1]) ^ _mixed(u[:, 1], FACTORS[2]) * np.uint64(3) ^ _mixed(u[:, 2], FACTORS[0])).view(np.int64)


def described(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """id, d (digest of the word sequence), x, y and z (fingerprint), r (its node), n (shingles) and cut
    (codes, as bytes) of every row with a key."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            digest, counts, sizes = [], np.zeros((batch.num_rows, 256), np.int64), []
            for i, t in enumerate(batch.column(1)):
                joined, hashes = shingles(t.as_py(), width)
                counts[i] = votes(hashes)
                sizes.append(len(hashes))
                digest.append(xxhash.xxh3_128_digest(joined))
            fps = np.packbits(counts[:, :192] > 0, axis=1).view(">i8").astype(np.int64)
            cuts = [c.tobytes() for c in codes_of(counts)]
            columns = [pa.array(digest, pa.binary()), *(pa.array(fps[:, i]) for i in range(3)), pa.array(node(fps)), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(cuts, pa.binary())], names=["id", "d", "x", "y", "z", "r", "n", "cut"])

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), text)
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[key]}, d binary, x long, y long, z long, r long, n long, cut binary")


# --- links under a common key ---------------------------------------------------------------


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, one a row."""
    return np.bitwise_count((x ^ y).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def _labels(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least row that each of `n` rows reaches by links (x, y)."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, x, label[y])
        np.minimum.at(least, y, label[x])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (x, y) between rows of `fps` that join whatever a chain of rows within `BITS` joins."""
    rest, xs, ys = np.arange(len(fps)), [], []
    while len(rest):
        frontier, rest = [int(rest[0])], rest[1:]
        while frontier and len(rest):
            i = frontier.pop()
            near = _far(fps[rest], fps[i]) <= BITS
            new, rest = rest[near], rest[~near]
            xs.append(np.full(len(new), i))
            ys.append(new)
            frontier.extend(new[::-1].tolist())
    return np.concatenate(xs or [rest]), np.concatenate(ys or [rest])


def _links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node it reaches) among sorted rows of complete keys."""
    names, first, at = np.unique(node(fps), return_index=True, return_inverse=True)
    order = np.lexsort((at, keys))  # the least node comes first, so keys agree on whom rows link to
    keys, fps, at = keys[order], fps[order], at[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    lengths = np.diff(np.append(starts, len(keys)))
    left, right = [], []
    for s, n in zip(starts[lengths > SMALL].tolist(), lengths[lengths > SMALL].tolist(), strict=True):
        x, y = forest(fps[s : s + n])
        left.append(x + s)
        right.append(y + s)
    small = np.flatnonzero(np.repeat((lengths > 1) & (lengths <= SMALL), lengths))
    for shift in range(1, min(SMALL, len(small))):
        x, y = small[:-shift], small[shift:]
        same = keys[x] == keys[y]
        x, y = x[same], y[same]
        near = _far(fps[x], fps[y]) <= BITS
        left.append(x[near])
        right.append(y[near])
    if not left:
        return names[:0], names[:0]
    label = _labels(len(names), at[np.concatenate(left)], at[np.concatenate(right)])
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]


def _stream(batches: Iterator[pa.RecordBatch], most: int, gathered: int) -> Iterator[pa.RecordBatch]:
    """Links (u, v) among rows (k, x, y, z) sorted by key; the rows of keys beyond `most` as they are."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    over: int | None = None  # a key already found too large
    names = ["u", "v", "k", "x", "y", "z"]

    def links(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        u, v = _links(k, f)
        for at in range(0, len(u), 10_000):
            n = len(u[at : at + 10_000])
            empty = [pa.nulls(n, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([pa.array(u[at : at + n]), pa.array(v[at : at + n]), *empty], names=names)

    def rows(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(k), 10_000):
            n = len(k[at : at + 10_000])
            empty, part = [pa.nulls(n, pa.int64())] * 2, f[at : at + n]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(k[at : at + n]), *(pa.array(c) for c in part.T)], names=names)

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, over
        k, f = (np.concatenate(c) for c in zip(*held, strict=True))
        if over is not None:
            n = int(np.searchsorted(k, over, "right"))
            yield from rows(k[:n], f[:n])
            k, f = k[n:], f[n:]
        cut = len(k) if last or not len(k) else int(np.searchsorted(k, k[-1]))
        large = int(np.searchsorted(k, k[-1])) if len(k) else 0
        if len(k) - large > most:
            cut, over = large, int(k[-1])
            yield from rows(k[large:], f[large:])
            k, f = k[:large], f[:large]
        if cut:
            yield from links(k[:cut], f[:cut])
        held = [(k[cut:], f[cut:])]

    size = 0
    for batch in batches:
        k = batch.column(0).to_numpy().astype(np.int64)
        held.append((k, np.stack([batch.column(i).to_numpy() for i in (1, 2, 3)], axis=1)))
        size += len(k)
        if size >= max(gathered, 2 * most):
            yield from flush(False)
            size = len(held[0][0])
    if held:
        yield from flush(True)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            codes = np.frombuffer(b"".join(part.column(0).to_pylist()), "<u2").reshape(-1, SEGMENTS, CODES)
            keys = keys_of(codes)
            own = pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))
            more = [part.column(i).take(own) for i in range(1, part.num_columns)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().astype(np.int32)), *more], names=["k", "x", "y", "z"])


LINKS = "u long, v long, k long, x long, y long, z long"


def linked(firsts: DataFrame) -> DataFrame:
    """Links (u, v) between nodes of `firsts` (cut, x, y, z) that join all rows which share a key and are
    within `BITS`, and whatever these join."""
    most, gathered = HELD, GATHERED

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _stream(batches, most, gathered)

    keyed = firsts.dropDuplicates(["x", "y", "z"]).select("cut", "x", "y", "z").mapInArrow(_expand, "k int, x long, y long, z long")
    found = saved(keyed.repartition("k").sortWithinPartitions("k").mapInArrow(stream, LINKS).distinct())
    links, large = found.where("k IS NULL").select("u", "v"), found.where("k IS NOT NULL").select("k", "x", "y", "z")
    if large.isEmpty():
        return links
    blocks = large.groupBy("k").agg(F.ceil(2 * F.count("*") / most).cast("int").alias("_n"))
    mine = F.pmod(F.xxhash64("x", "y", "z"), F.col("_n")).cast("int")
    dealt = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda t: F.least(mine, t) * F.col("_n") + F.greatest(mine, t))
    rows = large.join(blocks, "k").withColumn("_g", F.explode(dealt))  # a block meets every other one
    rows = rows.select(F.xxhash64("k", "_g").alias("k"), "x", "y", "z")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def out() -> Iterator[pa.RecordBatch]:
            f = np.concatenate(held)
            u, v = _links(np.zeros(len(f), np.int64), f)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            k = batch.column(0).to_numpy()
            f = np.stack([batch.column(i).to_numpy() for i in (1, 2, 3)], axis=1)
            for s, e in _runs(k):
                if held and k[s] != last:
                    yield from out()
                    held = []
                held, last = [*held, f[s:e]], k[s]
        if held:
            yield from out()

    more = rows.repartition("k").sortWithinPartitions("k").mapInArrow(pairs, "u long, v long")
    return saved(links.unionByName(more).distinct())


def _runs(k: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    cuts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True]))) if len(k) else np.zeros(0, int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


# --- verification on whole texts ------------------------------------------------------------


def similar(sets: list[np.ndarray], label: np.ndarray, least: float) -> np.ndarray:
    """`label` after every pair of sets with different labels and a similarity of `least` has joined theirs."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    for place, i in enumerate(order.tolist()):
        upto = np.searchsorted(sizes[order], sizes[i] / least + 1e-9, "right")
        rest = order[place + 1 : upto]
        rest = rest[label[rest] != label[i]]
        if not len(rest):
            continue
        if sizes[i] == 0:
            hit = rest
        else:
            n = sizes[rest]
            flat = np.concatenate([sets[j] for j in rest.tolist()])
            found = sets[i].take(np.searchsorted(sets[i], flat), mode="clip") == flat
            both = np.add.reduceat(found, np.cumsum(n) - n, dtype=np.int64)
            hit = rest[both / (sizes[i] + n - both) >= least]
        for other in set(label[hit].tolist()):
            label[label == other] = label[i]
    return label


def verified(rows: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Links (u, v), v the least id reached, of `rows` (id, d, c, p, g) whose texts are similar.

    All pairs of one (p, g) with different labels c are compared; `texts` are (id, text).
    """
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        held: dict[bytes, tuple] = {}
        at = None

        def out() -> Iterator[pa.RecordBatch]:
            ids, labels, sets = (list(c) for c in zip(*held.values(), strict=True))
            places = {c: i for i, c in enumerate(dict.fromkeys(labels))}
            after = similar(sets, np.array([places[c] for c in labels]), least)
            lowest: dict[int, object] = {}
            for i, c in zip(ids, after.tolist(), strict=True):
                lowest[c] = min(i, lowest.get(c, i))
            links = {(i, lowest[c]) for i, c in zip(ids, after.tolist(), strict=True) if i != lowest[c]}
            if links:
                u, v = zip(*sorted(links), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, batch.column(2).type), pa.array(v, batch.column(2).type)], names=["u", "v"])

        for batch in batches:
            for p, g, i, d, c, t in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if (p, g) != at:
                    if len(held) > 1:
                        yield from out()
                    held, at = {}, (p, g)
                joined, hashes = shingles(t, width)
                if xxhash.xxh3_128_digest(joined) == d:  # a repeated key may have other texts too
                    held[d] = (i, c, hashes)
        if len(held) > 1:
            yield from out()

    few = rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    with_text = texts.join(F.broadcast(rows) if few else rows, "id").select("p", "g", "id", "d", "c", "text")
    grouped = with_text.repartition("p", "g").sortWithinPartitions("p", "g")
    return saved(grouped.mapInArrow(run, f"u {kind}, v {kind}").distinct())


def _sent(groups: DataFrame) -> DataFrame:
    """One row a group, broadcast up to a bound: a large group's rows then stay where they are."""
    groups = saved(groups)
    return F.broadcast(groups) if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else groups


def _blocks(rows: DataFrame, by: str | list[str], least: int = 1) -> DataFrame:
    """`rows` of groups `by` of at least so many, with the number of blocks `_b` that a group fills."""
    sums = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_m"), F.sum("n").alias("_h")).where(F.col("_m") >= least)
    need = F.greatest(F.ceil(F.col("_m") / BLOCK), F.ceil(F.col("_h") / HASHES)).cast("int")
    named = [by] if isinstance(by, str) else by
    return rows.join(_sent(sums.select(*named, need.alias("_b"))), by)


def settled(large: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Links between the similar texts of groups p that fill several blocks; `large` is (id, d, n, p)."""

    def deal(rows: DataFrame, salt: str) -> DataFrame:
        return rows.withColumn("g", F.pmod(F.xxhash64(F.lit(salt), "d"), F.col("_b")))

    def named(links: DataFrame) -> DataFrame:
        member = components(links).distinct().withColumnsRenamed({"fp": "id", "root": "c"})
        return saved(large.join(member, "id", "left").withColumn("c", F.coalesce("c", "id")))

    # blocks by themselves, then some texts of every component found
    first = verified(deal(_blocks(large, "p"), "a").withColumn("c", F.col("id")).select("id", "d", "c", "p", "g"), texts, width, least)
    rows = named(first)
    sizes = rows.groupBy("p", "c").agg(F.count(F.lit(1)).alias("_s"))
    some = F.pmod(F.xxhash64(F.lit("b"), "d"), F.greatest(F.lit(1), F.floor(F.col("_s") / SAMPLE))) == 0
    stand = rows.join(_sent(sizes), ["p", "c"]).where(some | (F.col("id") == F.col("c"))).drop("_s")
    second = verified(deal(_blocks(stand, "p"), "c").select("id", "d", "c", "p", "g"), texts, width, least)
    links = first.unionByName(second).distinct()
    # what is outside a group's largest component meets every block of the group
    rows = named(links)
    sizes = rows.groupBy("p", "c").agg(F.count(F.lit(1)).alias("_s"))
    most = sizes.groupBy("p").agg(F.max(F.struct("_s", "c")).alias("_w")).select("p", F.col("_w.c").alias("_w"))
    sided = rows.join(_sent(most), "p").withColumn("_out", F.col("c") != F.col("_w")).drop("_w")
    sided = saved(deal(_blocks(sided, ["p", "_out"]), "e").select("id", "d", "c", "p", "_out", "_b", "g"))
    if sided.where("_out").isEmpty():
        return links
    counts = sided.groupBy("p").agg(
        F.max(F.when(F.col("_out"), F.col("_b"))).alias("_o"), F.max(F.when(~F.col("_out"), F.col("_b"))).alias("_i")
    ).where("_o IS NOT NULL")
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)
    inner = F.transform(every("_o"), lambda t: F.concat_ws("/", F.lit("x"), t, F.col("g")))
    outer = F.concat(
        F.transform(every("_i"), lambda t: F.concat_ws("/", F.lit("x"), F.col("g"), t)),
        F.transform(every("_o"), lambda t: F.concat_ws("/", F.lit("o"), F.least(t, F.col("g")), F.greatest(t, F.col("g")))),
    )
    met = sided.join(_sent(counts), "p").withColumn("g", F.explode(F.when(F.col("_out"), outer).otherwise(inner)))
    return links.unionByName(verified(met.select("id", "d", "c", "p", "g"), texts, width, least)).distinct()


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """One row per input row with a key: `key` and component_id, the least key that similar texts reach."""
    prints = saved(described(docs, key, text, width))
    firsts = saved(prints.groupBy("d").agg(F.min(F.struct("id", "x", "y", "z", "r", "n", "cut")).alias("_f")).select("d", "_f.*"))
    member = components(linked(firsts)).distinct()
    near = firsts.select("id", "d", "n", "r").join(member, F.col("r") == F.col("fp"), "left")
    near = near.select("id", "d", "n", F.coalesce("root", "r").alias("p"))
    sized = saved(_blocks(near, "p", 2))
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    small = sized.where("_b = 1").select("id", "d", F.col("id").alias("c"), "p", F.lit(0).alias("g"))
    links = verified(small, texts, width, least)
    large = sized.where("_b > 1").drop("_b")
    if not large.isEmpty():
        links = links.unionByName(settled(large, texts, width, least))
    roots = components(links).distinct()
    first_of = firsts.select("d", F.col("id").alias("fp")).join(roots, "fp", "left")
    first_of = saved(first_of.select("d", F.coalesce("root", "fp").alias("component_id")))
    return prints.select("id", "d").join(first_of, "d").select(F.col("id").alias(key), "component_id")
