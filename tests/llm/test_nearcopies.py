"""Near duplicates at five words and similarity 0.8 against all pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import nearcopies as N


def slow_groups(rows, width=5, least=0.8):
    """Least id of each component of all pairs of similar texts."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if (both / len(a | sets[j]) if a | sets[j] else 1.0) >= least:
                up[find(i)] = find(j)
    least_of = {}
    for i, (k, _) in enumerate(rows):
        least_of[find(i)] = min(k, least_of.get(find(i), k))
    return {k: least_of[find(i)] for i, (k, _) in enumerate(rows)}


def edited(rng, words, n):
    out = list(words)
    for at in rng.choice(len(out), n, replace=False):
        out[at] = f"x{rng.integers(1 << 30)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(25):  # families of edited copies, some near the bound
        words = [f"w{i}" for i in rng.integers(0, 4000, 150)]
        texts += [edited(rng, words, n) for n in (0, 1, 2, 3, 6, 40)]
    words = [f"v{i}" for i in rng.integers(0, 4000, 200)]
    texts += [edited(rng, words, int(rng.integers(0, 3))) for _ in range(60)]  # one dense group
    texts += ["", "  \n", None, "one", "One", "two three", texts[0], texts[0].upper()]
    order = rng.permutation(len(texts))
    return [(int(i), texts[o]) for i, o in enumerate(order)]


@pytest.mark.parametrize("bound", [{}, {"HELD": 20, "GATHERED": 30}, {"BLOCK": 16, "SAMPLE": 2}, {"HASHES": 900, "BROADCAST_ROWS": 10}])
def test_groups_equal_all_pairs(spark, rows, bound, monkeypatch):
    for name, value in bound.items():
        monkeypatch.setattr(N, name, value)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.groups(df).collect()}
    assert got == slow_groups(rows)


def family(seed, n=240):
    """One template with five words of its own a row (pairwise under 0.8), and for every third row a copy at 0.8 or more."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(n):
        places = rng.choice(np.arange(5, 295, 6), 8, replace=False)
        row = list(base)
        for at in places[:5]:
            row[at] = f"r{i}x{at}"
        texts.append(" ".join(row))
        if i % 3 == 0:
            for at in places[2:5]:
                row[at] = base[at]
            for at in places[5:]:
                row[at] = f"c{i}x{at}"
            texts.append(" ".join(row))
    return [(int(i), texts[o]) for i, o in enumerate(rng.permutation(len(texts)))]


def test_similar_rows_meet_though_others_are_closer_in_bits(spark):
    rows = family(7)
    want = slow_groups(rows)
    assert len(rows) - len(set(want.values())) >= 80
    got = {r.doc_id: r.component_id for r in N.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


@pytest.mark.parametrize("block", [256, 20])
def test_a_template_family_in_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "SAMPLE", 1)
    rows = family(11, 120)
    got = {r.doc_id: r.component_id for r in N.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == slow_groups(rows)


def test_links_of_keys_and_rows_of_large_keys():
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 63), 1 << 63, (40, 3))
    fps = np.concatenate([base ^ (np.int64(1) << rng.integers(0, 62, base.shape)) for _ in range(12)])
    fps = rng.permutation(fps)
    keys = np.sort(np.concatenate([rng.integers(0, 30, len(fps) - 90), np.full(90, 31)]))
    batches = [
        pa.RecordBatch.from_arrays([pa.array(c[i : i + 7]) for c in (keys.astype(np.int32), *fps.T)], names=["k", "x", "y", "z"])
        for i in range(0, len(keys), 7)
    ]
    out = pa.Table.from_batches(list(N._stream(iter(batches), 50, 60))).to_pylist()
    large = sorted((r["x"], r["y"], r["z"]) for r in out if r["k"] is not None)
    assert large == sorted(map(tuple, fps[keys == 31].tolist())) and {r["k"] for r in out} == {None, 31}
    names = N.node(fps)
    up = {n: n for n in names.tolist()}

    def joined(links):
        reach = dict(up)
        while True:
            old = dict(reach)
            for u, v in links:
                reach[u] = reach[v] = min(reach[u], reach[v])
            if old == reach:
                return reach

    want = [
        (int(names[i]), int(names[j]))
        for i in range(len(keys)) for j in range(i)
        if keys[i] == keys[j] != 31 and N._far(fps[i], fps[j]) <= N.BITS
    ]
    assert want and joined(want) == joined([(r["u"], r["v"]) for r in out if r["k"] is None])


def test_codes_are_those_nearest_to_the_votes():
    counts = np.random.default_rng(6).integers(-9, 10, (3, 256))
    signs = (N.codewords()[:, None] >> np.arange(23) & 1) * 2 - 1
    got = N.codes_of(counts)
    for t in range(3):
        for s in range(N.SEGMENTS):
            agreed = signs @ counts[t, 23 * s : 23 * s + 23]
            assert sorted(agreed[got[t, s]], reverse=True) == sorted(agreed, reverse=True)[: N.CODES]
    keys = N.keys_of(got)
    assert keys.shape == (3, 5 * N.CODES**2) and keys[0, 0] == int(got[0, 0, 0]) << 12 | int(got[0, 1, 0])


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long), (5, long), (5, long), (7, long), (8, None), (9, ""), (3, "w"), (4, " ".join(f"z{i}" for i in range(100_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"d": F.lit(1), "keys": F.lit("x"), "component_id": F.lit(2)})
    got = sorted(tuple(r) for r in N.groups(df).collect())
    assert got == [(3, 3), (4, 4), (5, 5), (5, 5), (7, 5), (8, 8), (9, 8)]
    assert N.groups(df.where("false")).collect() == []
