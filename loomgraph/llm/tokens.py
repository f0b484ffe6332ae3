"""Byte-level BPE through a sentencepiece model serialised straight from a rank file.

Every rank becomes one piece: its bytes mapped to printable characters, scored by minus its rank,
under an identity normaliser. A sentencepiece BPE encoder merges the best-scored neighbouring pair
first (leftmost on ties), which is the order of a rank file, so ids agree with rank-based encoders.
Texts are cut into pre-tokens first and each is encoded on its own; decoding is the inverse
mapping of pieces to bytes, joined in order.

One narrow pass over the scan and no shuffle: copies and hot sources cost their own bytes only, and
a lost executor repeats its own partitions. A worker keeps two caches of bounded size.

Defined edge cases: null and empty texts give no ids, both digests are of the empty string; equal
texts give equal rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ready, table

#: Entries of each cache before it is emptied, and the longest key it takes.
CACHE, CACHED_LENGTH = 600_000, 48

#: Two white-space characters in a row, where cutting at blanks is not cutting between pre-tokens.
DOUBLE = re.compile(r"\s\s")


def read_ranks(path: str) -> list[bytes]:
    """The pieces of a rank file (`base64 rank` lines) by rank; ranks must be gapless from 0."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes | None] = [None] * len(pairs)
    for piece, rank in pairs:
        out[int(rank)] = base64.b64decode(piece)
    if any(p is None for p in out):
        raise ValueError("ranks have gaps")
    return out  # type: ignore[return-value]


def byte_letters() -> list[str]:
    """A printable, non-blank character for each byte: itself where it is one, else from U+0100."""
    free = iter(range(0x100, 0x200))
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


def _field(number: int, payload: bytes | int | float) -> bytes:
    """One protocol-buffer field: bytes, varint or 32-bit float."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes([*out, n])

    if isinstance(payload, bytes):
        return varint(number << 3 | 2) + varint(len(payload)) + payload
    if isinstance(payload, float):
        return varint(number << 3 | 5) + struct.pack("<f", payload)
    return varint(number << 3) + varint(payload)


def sentencepiece_model(pieces: list[bytes]) -> bytes:
    """The serialised model: piece 0 is the unknown one, piece i + 1 has rank i."""
    letters = byte_letters()
    unknown = _field(1, "<unk>".encode()) + _field(2, 0.0) + _field(3, 2)
    body = [_field(1, unknown)]
    for rank, piece in enumerate(pieces):
        mapped = "".join(letters[b] for b in piece).encode()
        body.append(_field(1, _field(1, mapped) + _field(2, float(-rank)) + _field(3, 1)))
    trainer = _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, 0)  # BPE; size; id of the unknown piece
    plain = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join([*body, _field(2, trainer), _field(3, plain)])


class _Bounded(dict):
    """A dict that computes missing entries; short keys are kept until it is full, then it starts anew."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= CACHED_LENGTH:
            if len(self) >= CACHE:
                self.clear()
            self[key] = value
        return value


class Codec:
    """Encodes texts to little-endian 32-bit ids and back; `pattern` yields the pre-tokens."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.pieces = read_ranks(path)
        self.whole = {p: struct.pack("<I", r) for r, p in enumerate(self.pieces)}
        self.find = regex.compile(pattern).findall
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.pieces))
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.token = _Bounded(self._token)
        self.chunk = _Bounded(self._chunk)

    def _token(self, token: str) -> bytes:
        raw = token.encode("utf-8", "surrogatepass")
        if raw in self.whole:
            return self.whole[raw]
        ids = self.sp.encode(raw.decode("latin-1").translate(self.letters))
        return (np.array(ids, dtype="<u4") - 1).astype("<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return b"".join([self.token[t] for t in self.find(chunk)])

    def encode(self, text: str) -> bytes:
        """All ids of `text`. Between two non-blank characters, a single blank starts a pre-token,
        so the text may be cut there and its parts looked up; otherwise it is matched as a whole."""
        if not text:
            return b""
        if DOUBLE.search(text):
            return self._chunk(text)
        first, *rest = text.split(" ")
        chunk = self.chunk
        return chunk[first] + b"".join([chunk[" " + part] for part in rest])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec a worker, kept between tasks."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_documents(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False
) -> DataFrame:
    """Key, n_tokens, ids_sha256, decoded_sha256 and, with `keep_ids`, the ids as binary."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            n, ids_hex, raw_hex, kept = [], [], [], []
            for value in batch.column(1):
                ids = c.encode(value.as_py() or "")
                n.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                raw_hex.append(hashlib.sha256(c.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(ids)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(raw_hex, pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(kept, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return docs.select(key, text).mapInArrow(run, schema)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the public byte-level ranks and decoded again."""
    import public_tokenizers

    docs = table(ready(spark), sf_dir, "documents")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
