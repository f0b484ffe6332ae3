"""Token files: canonical length-limited Huffman blocks of ids, written in ascending key order.

Write path: texts are tokenised where they are scanned, each row is dealt to a key range (bounds
are quantiles of the key column alone), sorted, and packed into blocks of about `BLOCK_IDS` ids.
Every packing task also leaves a histogram; their sum over all rows gives the global counts, at most
one number for each vocabulary entry, from which package-merge makes optimal code lengths of at most
`LIMIT` bits. A second narrow pass turns each block into its coded form.

File format: a Parquet dataset with one row a block: `range`, `block` (their order is the order of
the ids), `keys`, and `data`: magic, number of ids, number of documents, ids of each document, the
bit offset of every `STEP`-th id, then the code bits. Blocks decode independently of each other and
checkpoints independently within a block: a table of 2^LIMIT entries yields a symbol and its length,
and all checkpoints of many blocks advance together. `codebook` beside it holds the code lengths, by
id; codes are canonical, so lengths are all there is to store.

Nothing here depends on one task seeing all rows: a key repeated in many rows is spread over the
ranges that it fills, and prefix sums use one row a range and then one row a block.

Defined edge cases: null and empty texts hold only the end id; null keys come first; rows repeated
under one key stay side by side, in an order that their ids alone decide; one text is never split over blocks; an empty
table gives an empty result.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ready, table
from .tokens import byte_letters

#: Ids of a block, ids between bit-offset checkpoints, longest code, rows of a key range.
BLOCK_IDS, STEP, LIMIT, RANGE_ROWS = 1 << 15, 128, 16, 4096
#: Most key ranges; a task sorts its range with spilling and packs it as a stream, so ranges may be large.
MAX_RANGES = 16_384
MAGIC = b"LGH1"
#: Entries of a worker's caches of parts and of words, and as many older ones.
CACHE = 200_000
LOWEST = np.iinfo(np.int64).min


# --- Huffman coding -------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes")
    by = used[np.argsort(counts[used], kind="stable")]
    coins = counts[by].astype(np.int64)
    level, flags = coins, [np.zeros(len(coins), bool)]
    for _ in range(limit - 1):
        even = len(level) // 2 * 2
        packs = level[0:even:2] + level[1:even:2]
        both = np.concatenate([coins, packs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        flags.append(order >= len(coins))
    take, lengths = 2 * len(coins) - 2, np.zeros(len(coins), np.uint8)
    for flag in reversed(flags):
        packs = int(flag[:take].sum())
        lengths[: take - packs] += 1
        take = 2 * packs
    out[by] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol: shorter first, then by symbol."""
    codes = np.zeros(len(lengths), np.int64)
    code = previous = 0
    used = np.flatnonzero(lengths)
    for s in used[np.lexsort((used, lengths[used]))].tolist():
        code <<= int(lengths[s]) - previous
        previous = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For every `limit` leading bits: symbol << 8 | length."""
    codes = canonical(lengths)
    out = np.zeros(1 << limit, np.int64)
    for s in np.flatnonzero(lengths).tolist():
        n = int(lengths[s])
        low = int(codes[s]) << (limit - n)
        out[low : low + (1 << (limit - n))] = s << 8 | n
    return out


def pack_block(ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    words = int(ends[-1] + 31) // 32 + 1 if len(ids) else 1
    value = (codes[ids].astype(np.uint64)) << (64 - (starts & 31) - n).astype(np.uint64)
    at = starts >> 5
    bits = np.bincount(at, (value >> np.uint64(32)).astype(np.float64), words)
    bits[1:] += np.bincount(at, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), words)[:-1]
    head = MAGIC + struct.pack("<II", len(ids), len(sizes))
    return head + sizes.astype("<u4").tobytes() + starts[::STEP].astype("<u8").tobytes() + bits.astype(">u4").tobytes()


def unpack_blocks(blocks: list[bytes], table: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, sizes of the documents) of each block; all checkpoints advance together."""
    lanes, bodies, shape, base = [], [], [], 0
    for data in blocks:
        if data[:4] != MAGIC:
            raise ValueError("not a block")
        n, docs = struct.unpack_from("<II", data, 4)
        sizes = np.frombuffer(data, "<u4", docs, 12)
        points = -(-n // STEP)
        start = np.frombuffer(data, "<u8", points, 12 + 4 * docs).astype(np.int64)
        body = data[12 + 4 * docs + 8 * points :]
        lanes.append(start + base * 8)
        bodies.append(body)
        shape.append((n, points, sizes))
        base += len(body)
    raw = np.frombuffer(b"".join(bodies) + bytes(8), np.uint8).astype(np.int64)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at = np.concatenate(lanes) if lanes else np.zeros(0, np.int64)
    out = np.empty((STEP, len(at)), np.int64)
    last = len(window) - 1
    for i in range(STEP):
        entry = table.take((window.take(np.minimum(at >> 3, last)) << (at & 7) & 0xFFFFFFFF) >> (32 - LIMIT))
        out[i] = entry >> 8
        at += entry & 0xFF
    flat = out.T.reshape(-1)
    result, lane = [], 0
    for n, points, sizes in shape:
        result.append((flat[lane * STEP : lane * STEP + n], sizes))
        lane += points
    return result


# --- tokenising -----------------------------------------------------------------------------


def _narrow(text: str) -> bool:
    """Whether a text is Latin-1."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Words:
    """Ids of texts by a tokenizers file, looked up word by word.

    Added tokens are cut out of a text first, as the library does. The normaliser works character by
    character and the splitting never joins over white space, so the rest may be cut at blanks, tabs
    and line breaks. Latin-1 text is lowered, split and byte-mapped here, as the file says, and its
    parts go to the file's merge model; a text beyond Latin-1 is cut into words, and those beyond it go
    to the library whole.
    """

    #: Letters, single numerals, contractions, other signs: the file's split over lower-case Latin-1.
    SPLIT = re.compile(
        "[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff]+|[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]|'s|'t|'re|'ve|'m|'ll|'d|"
        "[^\t-\r \u0085\u00a0a-z0-9\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff\u00b2\u00b3\u00b9\u00bc-\u00be]+"
    )

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        added = self.lib.get_added_tokens_decoder()
        #: added tokens that are found as they stand; files with other ones go to the library text by text
        self.plain = not any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values())
        self.added = {t.content: i for i, t in added.items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.merge = self.lib.model.tokenize
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.size = self.lib.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        class Cache(dict):
            """What `make` gives for each key. When it is full, its entries become the older half; those met again come back."""

            def __init__(self, make: Callable[[str], bytes]):
                super().__init__()
                self.make, self.older = make, {}

            def __missing__(self, key: str) -> bytes:
                ids = self.older.get(key)
                if ids is None:
                    ids = self.make(key)
                if len(key) <= 40:
                    if len(self) >= CACHE:
                        self.older = dict(self)
                        self.clear()
                    self[key] = ids
                return ids

        self.parts, self.words = Cache(self.merged), Cache(self.word)

    def direct(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def merged(self, part: str) -> bytes:
        """Ids of one lower-case Latin-1 part."""
        mapped = part.encode().decode("latin-1").translate(self.letters)
        return array("H" if self.kind.itemsize == 2 else "I", [t.id for t in self.merge(mapped)]).tobytes()

    def latin(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, self.SPLIT.findall(text.lower())))

    def word(self, word: str) -> bytes:
        """Ids of one word of a text that goes beyond Latin-1."""
        return self.latin(word) if _narrow(word) else self.direct(word)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text."""
        if not self.plain:
            return self.direct(text)
        if self.cut is None or not self.cut.search(text):
            return self.ordinary(text)
        parts = self.cut.split(text)  # every other part is an added token
        return b"".join(np.array([self.added[p]], self.kind).tobytes() if i % 2 else self.ordinary(p) for i, p in enumerate(parts))

    def ordinary(self, text: str) -> bytes:
        if _narrow(text):
            return self.latin(text)
        cut = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.words.__getitem__, cut))


_tokenisers: dict[str, Words] = {}


def _words(path: str) -> Words:
    if path not in _tokenisers:
        _tokenisers[path] = Words(path)
    return _tokenisers[path]


# --- files ----------------------------------------------------------------------------------


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, which driver and executors share."""
    ready(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that this session wrote."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def key_bounds(rows: DataFrame, key: str) -> np.ndarray:
    """Inner bounds of the key ranges: quantiles of the key column, at most MAX_RANGES."""
    n = rows.count()
    ranges = int(min(MAX_RANGES, max(1, n // RANGE_ROWS)))
    if ranges < 2:
        return np.zeros(0, np.int64)
    cuts = F.percentile_approx(F.col(key), F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(20 * ranges))
    return np.array(rows.select(cuts.alias("c")).first()["c"] or [], np.int64)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Write the token files of `docs` below `path`."""
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    bounds = key_bounds(rows, "key")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer)
        end = np.array([end_id], words.kind).tobytes()
        for batch in batches:
            ids = pa.array([words.encode(t or "") + end for t in batch.column(1).to_pylist()], pa.binary())
            keys = pc.fill_null(batch.column(0), LOWEST).to_numpy()
            low, high = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
            # a key that fills several ranges is dealt by its ids: the same on any recomputation
            spread = low + np.array([zlib.crc32(i.as_buffer()) for i in ids], np.int64) % (high - low + 1) if (high > low).any() else low
            spread[batch.column(0).is_null().to_numpy(zero_copy_only=False)] = 0
            yield pa.RecordBatch.from_arrays([pa.array(spread.astype(np.int32)), batch.column(0), ids], names=["range", "key", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer)
        counts = np.zeros(words.size, np.int64)
        names = ["range", "block", "keys", "sizes", "ids", "counts"]
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        held: list[tuple[int | None, bytes]] = []
        range_, block, size = None, 0, 0

        def row(*values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        def flush() -> pa.RecordBatch:
            nonlocal held, block, size, counts
            data = b"".join(i for _, i in held)
            counts += np.bincount(np.frombuffer(data, words.kind), minlength=words.size)
            sizes = [len(i) // words.kind.itemsize for _, i in held]
            out = row(range_, block, [k for k, _ in held], sizes, data, None)
            held, block, size = [], block + 1, 0
            return out

        for batch in batches:
            for r, k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if held and (r != range_ or size + len(i) > BLOCK_IDS * words.kind.itemsize):
                    yield flush()
                if r != range_:
                    range_, block = r, 0
                held.append((k, i))
                size += len(i)
        if held:
            yield flush()
        if counts.any():
            yield row(None, None, None, None, None, counts.tobytes())

    staged = f"{path}/staged"
    (
        rows.mapInArrow(tokenise, "range int, key long, ids binary")
        .repartition("range")
        .sortWithinPartitions("range", F.asc_nulls_first("key"), "ids")
        .mapInArrow(pack, "range int, block int, keys array<long>, sizes array<int>, ids binary, counts binary")
        .write.option("compression", "zstd").parquet(staged)
    )
    stage = spark.read.parquet(staged)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for c in batch.column(0):
                part = np.frombuffer(c.as_py(), np.int64)
                total = part.copy() if total is None else total + part
        if total is not None:
            ids = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    summed = stage.where("counts IS NOT NULL").select("counts").mapInArrow(add_up, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    size, kind = _words(tokenizer).size, _words(tokenizer).kind
    counts = np.zeros(size, np.int64)
    got = summed.toArrow()  # at most one row for each vocabulary entry
    counts[got["id"].to_numpy()] = got["n"].to_numpy()
    lengths = code_lengths(counts)
    codes = canonical(lengths)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [
                pack_block(np.frombuffer(i.as_py(), kind), s.values.to_numpy(), lengths, codes)
                for s, i in zip(batch.column(3), batch.column(4), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(data, pa.binary())], names=["range", "block", "keys", "data"])

    (
        stage.where("counts IS NULL").select("range", "block", "keys", "sizes", "ids")
        .mapInArrow(code, "range int, block int, keys array<long>, data binary")
        .write.option("compression", "none").parquet(f"{path}/blocks")
    )
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    delete(spark, staged)


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Key, start, n_tokens and ids_crc32 of every document, decoded from the files below `path`."""
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/codebook").first()["lengths"]), np.uint8)
    blocks = spark.read.parquet(f"{path}/blocks")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                found = unpack_blocks(part.column(3).to_pylist(), table)
                for r, b, keys, (ids, sizes) in zip(part.column(0), part.column(1), part.column(2), found, strict=True):
                    raw = memoryview(ids.astype("<u4").tobytes())
                    ends = np.cumsum(sizes.astype(np.int64))
                    starts = ends - sizes
                    crcs = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                    n = len(sizes)
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(r, n), pa.repeat(b, n), keys.values, pa.array(starts), pa.array(sizes.astype(np.int64)), pa.array(crcs, pa.int64())],
                        names=["range", "block", "key", "within", "n_tokens", "ids_crc32"],
                    )

    docs = blocks.select("range", "block", "keys", "data").mapInArrow(
        decode, "range int, block int, key long, within long, n_tokens long, ids_crc32 long"
    )

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [struct.unpack_from("<I", h.as_py(), 4)[0] for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["range", "block", "n"])

    heads = blocks.select("range", "block", F.substring("data", 1, 12).alias("head"))
    sizes = heads.mapInArrow(ids_of, "range int, block int, n long")
    totals = sizes.groupBy("range").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = totals.select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("range").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    index = sizes.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(bases), "range")
    return docs.join(index.select("range", "block", (F.col("base") + F.col("before")).alias("_0")), ["range", "block"]).select(
        F.col("key").alias(key), (F.col("_0") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )


def op6_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written to token files and read back."""
    import public_tokenizers

    path = shared_folder(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 1)
    return read(spark, path)
