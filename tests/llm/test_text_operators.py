"""Licences, sharding, tokens, token files and personal data against brute force."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from loomgraph.llm import licenses, pii, sharding, tokenfile, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, k string, size string"
TEXTS = [
    "Plain words, twice. Plain words.", "", None, "  ", "a" * 30000, "x  y\n\n z\tq ", "naïve Straße 日本語 🙂", "same text", "same text",
    "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", "mail a.b+c@d-e.co.uk or +1 (640) 555-0953, card 4111 1111 1111 1111 at 10.0.0.255 999.1.1.1",
    "<|endoftext|> don't I'LL we've 12345", "All rights reserved.\nnothing; This work is licensed under the GNU General Public License, version 3.",
]


def table(spark, texts=TEXTS, ids=None):
    ids = ids if ids is not None else range(len(texts))
    rows = [(i, t, None, "s", None, "clash", "clash", "clash", "clash") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def by_id(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is not None, r[key]))


def test_licences(spark):
    got = {r["doc_id"]: r for r in by_id(licenses.recognise(table(spark).select("doc_id", "text")))}
    assert got[9]["sentence_ids"] == "apache2,mitReleased" and got[9]["licenses"] == "MIT,Apache-2.0" and got[9]["unmatched"] == ""
    assert got[12]["licenses"] == "GPL-3.0-only,LicenseRef-proprietary"
    for i in (0, 1, 2, 3, 4):
        assert (got[i]["sentence_ids"], got[i]["licenses"]) == ("", "")
    rules = (("AB", ("mitReleased", "apache2")), ("A", ("apache2",)))
    t = ["Released under the MIT License.\nLicensed under the Apache License, Version 2.0.\n" * 2 + "All rights reserved."]
    (row,) = by_id(licenses.recognise(table(spark, t).select("doc_id", "text"), rules=rules))
    assert row["licenses"] == "AB" and row["unmatched"] == "allRights"
    assert licenses.recognise(table(spark).limit(0)).count() == 0


def test_printed_licences(spark):
    """Printed texts are found however they are wrapped, in comments, below copyright lines and between other text."""
    import textwrap

    texts, want = [], []
    for name, text in licenses.PRINTED:
        for width in (40, 70, 1000):
            body = "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in text.split("\n\n"))
            for form in (body, body.replace("\n", "\r\n"), "\n".join(f" * {line}" for line in body.split("\n")), f"Some words first.\n\nCopyright 2020 A B\n{body}\n\nAnd last."):
                texts.append(form)
                want.append(name)
    rows = table(spark, texts).select("doc_id", "text").selectExpr("*", "'mine' AS _ids", "1 AS _hit", "2 AS licenses")
    got = by_id(licenses.recognise(rows))
    for r, name in zip(got, want, strict=True):
        assert (r["licenses"], r["unmatched"], r["_ids"]) == (name, "", "mine"), (texts[r["doc_id"]], r)


def test_long_sentences_are_normalised_before_any_test(spark):
    (row,) = by_id(licenses.recognise(table(spark, ["Licensed under" + " " * 700 + "the Apache License, Version 2.0."]).select("doc_id", "text")))
    assert row["licenses"] == "Apache-2.0"


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_sharding_laws(spark, shards):
    got = by_id(sharding.assign(table(spark), shards))
    for r, t in zip(got, TEXTS, strict=True):
        raw = (t or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
    assert [r["shard"] for r in got] == sorted(r["shard"] for r in got)
    total, longest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for s in range(shards):
        rows = [r for r in got if r["shard"] == s]
        assert [r["slot"] for r in rows] == list(range(len(rows)))
        assert abs(sum(r["size"] for r in rows) - total / shards) <= longest


def test_sharding_edges(spark):
    assert sharding.assign(table(spark, [])).count() == 0
    same = by_id(sharding.assign(table(spark, ["x"] * 40 + [None], [7] * 40 + [None]), 4))
    slots = sorted((r["shard"], r["slot"]) for r in same)
    assert len(set(slots)) == 41


def test_bpe_equals_the_rank_library(spark):
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(tokens.encode_documents(table(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep_ids=True))
    for r, t in zip(got, TEXTS, strict=True):
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        assert r["n_tokens"] == len(ids) and bytes(r["ids"]) == ids.tobytes()
        assert r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    rng = random.Random(3)
    c = tokens.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for _ in range(400):
        t = "".join(rng.choice("ab'st \n\té日1.\x1c\x85 ") for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(c.encode(t), "<u4").tolist() == library.encode_ordinary(t)


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(0)
    for n, limit in ((1, 16), (2, 16), (40, 6), (3000, 13), (500, 16)):
        counts = np.zeros(n + 5, np.int64)
        counts[:n] = rng.zipf(1.3, n)
        got = tokenfile.code_lengths(counts, limit)
        used = got[got > 0].astype(float)
        assert (got > 0).tolist() == (counts > 0).tolist() and got.max() <= limit
        assert n == 1 or abs((2.0**-used).sum() - 1) < 1e-12
    # against plain Huffman where the limit does not bind
    import heapq

    counts = rng.integers(1, 1000, 60)
    heap = [int(c) for c in counts]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        cost += s
        heapq.heappush(heap, s)
    assert int((counts * tokenfile.code_lengths(counts, 30)).sum()) == cost


def test_token_blocks_round_trip():
    rng = np.random.default_rng(1)
    counts = rng.zipf(1.2, 4000).clip(0, 10**6)
    lengths = tokenfile.code_lengths(counts)
    codes, lookup = tokenfile.canonical(lengths), tokenfile.decode_table(lengths)
    blocks, want = [], []
    for n in (1, 2, 127, 128, 129, 5000):
        ids = rng.choice(4000, n)
        blocks.append(tokenfile.pack_block(ids, np.array([n]), lengths, codes))
        want.append(ids)
    for (ids, sizes), w in zip(tokenfile.unpack_blocks(blocks, lookup), want, strict=True):
        assert (ids == w).all() and sizes.tolist() == [len(w)]


def test_token_files(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = tokenfile.shared_folder(spark, "test-tokens")
    ids = [None, *range(1, len(TEXTS))]
    tokenfile.write(table(spark, TEXTS, ids), path, P.path("word_bpe_49k.json"), 1)
    got = by_id(tokenfile.read(spark, path))
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    at = 0
    for r, t in zip(got, TEXTS, strict=True):
        want = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    empty = tokenfile.shared_folder(spark, "test-empty")
    tokenfile.write(table(spark, []), empty, P.path("word_bpe_49k.json"), 1)
    assert tokenfile.read(spark, empty).count() == 0


def test_words_equal_the_library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    words = tokenfile.Words(P.path("word_bpe_49k.json"))
    rng = random.Random(5)
    signs = [*"abT'sLl \n\téÉß日1.9\x0b\x1c\x85 İΣ", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext"]
    for _ in range(1500):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(words.encode(t), words.kind).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_pii_base_spans():
    rng = random.Random(0)
    cases = [t for t in TEXTS if t] + ["a@b.c@d.e@f", "@@a@b.c", "1.2.3.4.5.6.7.8", "1..2.3.4", "é@x.y ü.a@ö.z", "4111-1111-1111-1111 2"]
    cases += ["".join(rng.choice("a1.@+ -()9") for _ in range(50)) for _ in range(4000)]
    for t in cases:
        assert pii.base_spans(t)[0] == plain_spans(t), repr(t)


def test_pii_rows_and_redaction(spark):
    model = pii.Model.fit(1200)
    got = by_id(pii.find(table(spark), model=model))
    for r, t in zip(got, TEXTS, strict=True):
        base = plain_spans(t or "")
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(pii.show(base).encode()).hexdigest()
        assert set(filter(None, pii.show(base).split(","))) <= set(r["spans"].split(","))
    red = {r["doc_id"]: r["text"] for r in by_id(pii.redact(table(spark), model=model))}
    assert red[2] is None and red[0] == TEXTS[0]
    assert red[10] == "mail [EMAIL] or [PHONE], card [CARD] at [IP] 999.1.1.1"
    assert pii.find(table(spark, []), model=model).count() == 0


def test_pii_spelled_out_in_capitals():
    text = "SALES [AT] ACME [DOT] COM"
    assert pii.candidates(text, []) == [("email", 0, len(text))]


def test_pii_model_adds_and_refuses():
    model = pii.Model.fit(3000)
    yes = ["mail john [at] corp [dot] com now", "call (212) 555-1234 today"]
    no = ["version 10.2.3 of 2024-01-01", 'token = "1234567890123456"', "isbn 9783161484100x"]
    assert all(len(s) == 1 for _, s in model.select(yes)) and not any(s for _, s in model.select(no))
