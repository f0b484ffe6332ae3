"""Near duplicates, vector search, toxicity, mixing and the pipeline against brute force."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from loomgraph.llm import ann, common, mixing, simhash, topk, toxicity


def flip(x: int, bits) -> int:
    for b in bits:
        x ^= 1 << int(b)
    return x - (1 << 64) if x >> 63 else x


def union_find(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near(values):
    u = np.array(values, np.int64).view(np.uint64)
    return [(i, j) for i in range(len(u)) for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 4).tolist() if j > i]


def test_golay_code_is_perfect_and_keys_meet():
    assert len(set(simhash._ERRORS.tolist())) == 2048
    rng = np.random.default_rng(0)
    for _ in range(300):
        x = int(rng.integers(0, 1 << 63))
        y = flip(x, rng.choice(64, rng.integers(0, 5), replace=False))
        kx, ky = (set(simhash.keys_of(np.array([v], np.int64))[0].tolist()) for v in (x, y))
        assert kx & ky


def slow_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    out = 0
    for b in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) > len(shingles):
            out |= 1 << b
    return out - (1 << 64) if out >> 63 else out


def test_fingerprints():
    for t in (None, "", " \t\n", "One", "one two three", "A b C d", "a b c d e a b c d e", "É x\x0by z q r s t" * 40):
        assert simhash.fingerprint(t) == slow_fingerprint(t), t


def dense(rng, centres=3, each=120):
    out = set()
    for _ in range(centres):
        c = int(rng.integers(0, 1 << 63))
        out |= {flip(c, rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(each)}
    return sorted(out)


def test_components_equal_brute_force(spark):
    common.ready(spark)
    values = dense(np.random.default_rng(1))
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r.fp: r.root for r in simhash.components(simhash.link(df)).collect()}
    want = union_find(len(values), near(values))
    assert all(got.get(v, v) == values[w] for v, w in zip(values, want, strict=True))


def test_members_of_large_keys_are_linked_exactly(spark, monkeypatch):
    common.ready(spark)
    monkeypatch.setattr(simhash, "HELD", 6)
    monkeypatch.setattr(simhash, "GATHERED", 40)
    values = dense(np.random.default_rng(2), 2, 60)
    keys, owners = simhash.keys_of(np.array(values, np.int64))
    order = np.argsort(keys, kind="stable")
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[order][i : i + 17]), pa.array(owners[order][i : i + 17])], names=["k", "f"]) for i in range(0, len(order), 17)]
    u, v = [], []
    for b in simhash._stream(iter(batches)):
        u += b.column(0).to_pylist()
        v += b.column(1).to_pylist()
    large = sorted({a for a, b in zip(u, v, strict=True) if b is None})
    assert large
    links = [(a, b) for a, b in zip(u, v, strict=True) if b is not None]
    balls = simhash.ball_links(spark.createDataFrame([(x,) for x in large], "u long")).collect()
    links += [(r.u, r.v) for r in balls]
    place = {x: i for i, x in enumerate(values)}
    assert union_find(len(values), [(place[a], place[b]) for a, b in links]) == union_find(len(values), near(values))


def test_cluster_edges(spark):
    long = " ".join(f"w{i % 97}" for i in range(400))
    rows = [(5, long, "x"), (3, long, "x"), (9, None, "x"), (8, "", "x"), (7, "lone words only here now", "x"), (None, long, "x"), (4, long + " tail", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: r.component_id for r in simhash.cluster(df).collect()}
    assert got[5] == got[3] == got[None] == 3 and got[9] == got[8] == 8 and got[7] == 7
    assert simhash.cluster(df.limit(0)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, x, ids=None, extra=()):
    ids = ids if ids is not None else range(len(x))
    return spark.createDataFrame([(int(i), [float(v) for v in r], 0) for i, r in zip(ids, x, strict=True)] + list(extra), VECTORS).repartition(3)


BAD = [(1000, None, 0), (1050, [1.0, None], 0), (1100, [float("nan"), 1.0], 0), (1150, [float("inf"), 1.0], 0), (1200, [], 0), (None, [1.0, 2.0], 0)]


@pytest.mark.parametrize("dims,n", [(1, 30), (3, 200), (64, 700)])
def test_top_k_equals_brute_force(spark, dims, n, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(topk, "ROWS", 150)
    rng = np.random.default_rng(dims)
    x = np.round(rng.standard_normal((n, dims)), 1).astype(np.float32)
    x[5:40] = x[4]
    got = topk.top_k(
        topk.finite(vectors(spark, x, extra=BAD)).withColumn("codes", F.transform("embedding", lambda v: F.floor(v.cast("double") * 256))), F.col("vec_id") % 10 == 0, 5
    ).collect()
    codes = np.floor(256 * x.astype(float)).astype(int)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == {i for i in range(n) if i % 10 == 0}
    for q, hits in found.items():
        s = codes @ codes[q]
        order = [i for i in np.lexsort((np.arange(n), -s)).tolist() if i != q][:5]
        assert hits == [(i, int(s[i])) for i in order]


def test_repeated_queries_and_empty_vectors(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, [1, 2]), (0, [1, 2]), (1, [1, 1])], "vec_id long, codes array<long>")
    assert [(r.query_id, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 0, 5).collect()] == [(0, 1, 3)]
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0, 5).count() == 0
    assert ann.search(vectors(spark, np.zeros((3, 2))), F.col("vec_id") == 0, 5).count() == 0


def test_ann_recall_and_scores(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(ann, "LIST_ROWS", 250)
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((12, 32))[rng.integers(0, 12, 3000)] * 2 + rng.standard_normal((3000, 32))).astype(np.float32)
    x[100:160] = x[99]
    rows = ann.search(vectors(spark, x, extra=BAD), F.col("vec_id") % 100 == 0, 10).collect()
    hit = total = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = set(np.lexsort((np.arange(3000), d))[:10].tolist())
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and all(abs(r.score - d[r.vec_id]) < 1e-12 for r in mine)
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        hit += len(best & {r.vec_id for r in mine})
        total += 10
    assert hit / total >= 0.9
    few = ann.search(vectors(spark, x[:6]), F.col("vec_id") == 0, 10)
    assert few.count() == 5


def test_ann_searches_every_length(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.standard_normal([2, 3, 5][i % 3])], 0) for i in range(300)]
    got = ann.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0, 4).collect()
    for q in range(0, 300, 50):
        x = np.array(rows[q][1], np.float32).astype(float)
        same = [(float(np.sqrt(((np.array(v, np.float32).astype(float) - x) ** 2).sum())), i) for i, v, _ in rows if len(v) == len(x) and i != q]
        mine = [(r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
        assert [i for _, i in mine] == [i for _, i in sorted(same)[:4]]
    assert ann.turned(np.eye(3000)).shape == (3000, 3000)


def test_lists_are_read_from_their_ends_only():
    rng = np.random.default_rng(8)
    rows = np.rint(rng.standard_normal((4000, 6)) ** 3 * 40).astype(np.int64)
    lists = topk.Lists(rows, np.arange(4000))
    asked = list(range(0, 200, 2))
    for q, (ids, scores) in zip(asked, lists.search(rows[asked], asked, np.full(len(asked), -np.inf), 5), strict=True):
        s = rows @ rows[q]
        want = [i for i in np.lexsort((np.arange(4000), -s)).tolist() if i != q][:5]
        assert ids.tolist() == want and scores.tolist() == s[want].tolist()
    assert np.mean(lists.depths) < 4000  # reading stops before the lists' ends


def test_toxicity_restores_and_scores(spark, data):
    docs = common.table(common.ready(spark), data, "documents")
    model = toxicity.CharModel(toxicity.count_trigrams(docs))
    for written, meant in {"m0r0n": "moron", "id.i.ot": "idiot", "idiooooot": "idiot", "$tupid": "stupid", "tra$h": "trash", "555": "555", "word,": "word"}.items():
        assert model.restore(written) == meant
    for written, meant in {"he is an i d i o t ok": ["idiot"], "so a n i d i o t, then": ["an idiot", "anidiot"], "i . d . i . o . t": ["idiot"], "s-t-u-p-i-d  i-d-i-o-t": ["stupid idiot", "stupididiot"], "i_d_1_0_t": ["idiot"], "1 2 3 4": []}.items():
        assert list(model.spelled(written)) == meant, written


def test_decoding_finds_the_cheapest_of_all_paths():
    import itertools

    rng = np.random.default_rng(1)
    model = toxicity.CharModel(rng.integers(0, 40, toxicity.SYMBOLS**3) * (rng.random(toxicity.SYMBOLS**3) < 0.02))

    def price(path):
        text = "".join(w for w, _ in path)
        x = [0, 0, *(int(toxicity._TABLE[ord(c)]) for c in text), 0]
        return sum(p for _, p in path) + sum(float(model.cost[a, b, c]) for a, b, c in zip(x, x[1:], x[2:], strict=False))

    lattices = [model.lattice(t) for t in ("m0r0n", "$tu|d", "idiiiot!", "@1b2", "a((b", "ß0x-1")] + [model.gapped(t) for t in ("i d 1 0 t", "a b  c", "x . y . z")]
    for lattice in lattices:
        paths = [*itertools.product(*lattice)]
        least = min(map(price, paths))
        got = model.decode(lattice)
        assert any(abs(price(p) - least) < 1e-3 and "".join(w for w, _ in p).strip() == got for p in paths)


def test_long_disguises_are_restored(spark, data):
    model = toxicity.CharModel(toxicity.count_trigrams(common.table(common.ready(spark), data, "documents")))
    for sign in ",/._":
        written = sign.join(["$tupid", "wretched", "m0r0n", "completely", "idiooooot", "garbage", "people"])
        got = set(toxicity._Tokens(model, None)[written])
        assert all(got.issuperset(toxicity._hashed(word)) for word in ("stupid", "moron", "idiot", "garbage")), sign
    letters = "stupidmoronidiotpathetictrashgarbageworthless"
    for sign in " .-*_":
        assert "".join(next(iter(model.spelled(sign.join(letters)))).split()) == letters, sign
    long = "$tupid," * 3000
    assert model.restore(long).count("stupid") == 3000


def test_toxicity_learns_from_allowed_rows_only(spark):
    import zlib

    rng = np.random.default_rng(0)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        body = [*rng.choice(words, 12), *(["vile"] if bad else [])]
        rows.append((i, " ".join(body), "junk"))
        held = zlib.crc32(str(i).encode()) % 5 == 0
        marks.append((i, int(bad) if not held else int(not bad), None))  # labels of held-out rows lie
    rows += [(400, None, "junk"), (401, "", "junk"), (402, "v1le", "junk")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([*marks, (402, None, None)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels)).collect()}
    assert all((got[i].score >= 0.5) == (i % 4 == 0) for i in range(400))
    assert got[400].score == got[401].score and 0 <= got[400].score < 0.5
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 403 - sum(r.score >= 0.5 for r in got.values())
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs.select("doc_id", "text"), none).collect()} == {0.5}


def drawn_shares(cells):
    p = np.minimum(1, cells.weights) * cells.tokens
    return [np.bincount(g, p, len(goal)) / p.sum() for g, goal in zip(cells.groups, cells.goals, strict=True)]


@pytest.mark.parametrize("budget", [0.3, 0.6, 0.95])
def test_draws_meet_the_marginals(budget):
    rng = np.random.default_rng(0)
    groups = [np.arange(60) % 5, np.arange(60) // 5 % 4, np.arange(60) // 20]
    goals = [np.full(5, 0.2), np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.25, 0.25])]
    cells = mixing.Cells(rng.integers(1, 1000, 60).astype(float), groups, goals)
    reached = mixing.rake(cells, budget)
    for share, goal in zip(drawn_shares(cells), goals, strict=True):
        assert np.allclose(share, goal, rtol=2e-4)
    kept = (np.minimum(1, cells.weights) * cells.tokens).sum() / cells.tokens.sum()
    assert abs(kept - reached) < 1e-3 and reached <= budget
    if budget == 0.3:
        assert reached == 0.3
    if budget == 0.95:
        assert (cells.weights > 1).any()  # some cells are drawn whole, and the others make up for them


def test_targets_never_ask_for_more_than_a_group_can_lift():
    tokens = np.array([1000.0, 400.0, 30.0, 0.5, 0.0])
    for power in (0.3, 0.7, 1.0):
        goal = mixing.targets(list("abcde"), tokens, power)
        assert abs(goal.sum() - 1) < 1e-12 and (goal <= mixing.LIFT * tokens / tokens.sum() + 1e-12).all()
    assert np.allclose(mixing.targets(list("abcde"), tokens, 1.0), tokens / tokens.sum())
    langs = mixing.targets(["en", "de", None], np.array([100.0, 800.0, 100.0]), None)
    assert np.allclose(langs[0], 0.125) and abs(langs.sum() - 1) < 1e-12


def test_contradicting_targets_end():
    cells = mixing.Cells(np.array([100.0, 200.0]), [np.array([0, 1])] * 2, [np.array([0.9, 0.1]), np.array([0.1, 0.9])])
    assert 0 < mixing.rake(cells) <= mixing.BUDGET and np.isfinite(cells.weights).all()


def test_topics_are_lloyd_over_all_rows(spark, monkeypatch):
    """Centroids against the same rounds in memory, whatever the partitioning."""
    common.ready(spark)
    monkeypatch.setattr(mixing, "SAMPLE", 20)
    rng = np.random.default_rng(2)
    texts = [" ".join(f"{'abcd'[i % 4]}{j}" for j in rng.integers(0, 30, 40)) for i in range(400)]
    x = np.array([mixing.profile(t)[1] for t in texts]).astype(float)
    rows = [(i, bytes(p.astype(np.uint8))) for i, p in enumerate(x)]
    slim = spark.createDataFrame([*rows, rows[3]], "doc_id long, _profile binary")
    got = [mixing.topic_centres(slim.repartition(n), "doc_id") for n in (1, 5)]
    assert (got[0] == got[1]).all()
    x = np.concatenate([x, x[3:4]])
    near = mixing.nearest(x, got[0])
    again = np.array([x[near == c].mean(0) if (near == c).any() else got[0][c] for c in range(len(got[0]))])
    assert np.allclose(again, got[0], atol=0.5)  # nearly a fixed point after LLOYD rounds


def test_every_row_is_drawn_as_its_cell_says(spark, data):
    """mix() against the same sums made from its own rows."""
    docs = common.table(common.ready(spark), data, "documents")
    rows = mixing.mix(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert all(r.tokens == len((texts[r.doc_id] or "").encode().lower().split()) for r in rows)
    names = [sorted({r[m] for r in rows}) for m in ("source", "lang", "topic")]
    groups = [np.array([n.index(r[m]) for r in rows]) for n, m in zip(names, ("source", "lang", "topic"), strict=True)]
    tokens = np.array([float(r.tokens) for r in rows])
    goals = [mixing.targets(n, np.bincount(g, tokens), p) for n, g, (_, p) in zip(names, groups, mixing.MARGINS, strict=True)]
    p = np.array([r.probability for r in rows]) * tokens
    for g, goal in zip(groups, goals, strict=True):
        assert np.abs(np.bincount(g, p, len(goal)) / p.sum() - goal).max() < 0.01
    drawn = np.array([float(r.drawn) for r in rows])
    assert abs((drawn * tokens).sum() / p.sum() - 1) < 0.25


def test_mixing_rows(spark):
    rows = [(i, "the cat sat" if i % 3 else "un gato duerme aqui", "en" if i % 3 else None, None if i % 7 == 0 else "s") for i in range(300)]
    rows += [(300, None, "en", "s"), (301, "", "zz", "t"), (302, "x " * 20000, "en", "s"), (None, "the cat", "en", "s"), (5, "the cat sat", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(0 <= r.probability <= 1 for r in got)
    assert len({r.drawn for r in got if r.doc_id == 5}) == 1
    kept = mixing.sample(df)
    assert kept.columns == df.columns and kept.count() == sum(r.drawn for r in got)
    assert mixing.mix(df.limit(0)).count() == 0
    named = df.selectExpr("*", "1 AS _k", "2 AS _drawn", "3 AS _topic", "4 AS _tokens", "5 AS weight")
    assert mixing.sample(named).columns == named.columns and mixing.sample(named).count() == kept.count()


def test_many_cells_are_raked_alike(spark, monkeypatch):
    """The DataFrame steps against the array steps, for as many rounds and budgets."""
    common.ready(spark)
    monkeypatch.setattr(mixing, "ROUNDS", 4)
    monkeypatch.setattr(mixing, "TRIES", 1)
    langs = ["en", "de", None]  # sources of nearly one language
    rows = [(f"s{i}", lang, k, 1000 * (i + 1) if lang == langs[i % 3] and k == i % 2 else 1 + i + k) for i in range(3) for lang in langs for k in range(2)]
    cells = common.saved(spark.createDataFrame(rows, "source string, lang string, _topic int, _tokens long").coalesce(1))
    done = {}
    for most in (50_000, 1):
        monkeypatch.setattr(mixing, "MAX_CELLS", most)
        done[most] = {(r.source, r.lang, r._topic): (r.weight, r.probability) for r in mixing.weigh(cells).collect()}
    assert done[1].keys() == done[50_000].keys()
    assert all(np.allclose(done[1][c], done[50_000][c], rtol=1e-9, atol=0) for c in done[1])


def test_pipeline_stages(spark, data):
    import corpus_pipeline

    docs = common.table(common.ready(spark), data, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data).persist()
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= before, name
        before, docs = out.count(), out
    texts = {r.doc_id for r in docs.collect()}
    done = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert {r.doc_id for r in done} == texts


def test_pipeline_run_equals_its_stages_by_hand(spark, data):
    """run() against the parts each stage is made of: what is dropped, kept once, covered, drawn and encoded."""
    import corpus_pipeline
    from loomgraph.llm import nearcopies, pii, tokens

    import public_tokenizers as P

    docs = common.table(common.ready(spark), data, "documents")
    labels = common.table(spark, data, "labels")
    scorer = toxicity.train(docs, labels)
    words = scorer.tokens()
    rows = {r.doc_id: r for r in docs.collect() if scorer.score(r.text or "", words) < 0.5}
    left = spark.createDataFrame(list(rows.values()), docs.schema)
    of = {r.doc_id: r.component_id for r in nearcopies.groups(left).collect()}
    rows = {i: r for i, r in rows.items() if of[i] == i}
    model = pii.Model.fit()
    covered = {i: pii.cover(r.text, model.select([r.text])[0][1]) for i, r in rows.items()}
    left = spark.createDataFrame([(i, covered[i], r.lang, r.source, len(covered[i])) for i, r in rows.items()], docs.schema)
    drawn = {r.doc_id for r in mixing.mix(left).collect() if r.drawn}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, data).collect()}
    assert set(got) == drawn
    plain = tokens.encode_documents(left, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    want = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in plain}
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[i] for i, r in got.items())


def test_every_stage_takes_odd_rows(spark, data):
    """Nulls in any column, empty, repeated and long texts, an empty table, and columns of clashing names."""
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(4000))
    rows = [(1, None, None, None, None), (None, "a few words", "en", "s", 11), (2, "", "en", None, 0), (3, long, None, "s", 9), (3, long, None, "s", 9), (4, "same text here", "en", "s", 14), (4, "other text here", "en", "s", 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = docs.selectExpr("*", *(f"{i} AS `{c}`" for i, c in enumerate(("score", "_toxicity", "id", "d", "r", "n", "p", "component_id", "_k", "_drawn", "_topic", "_tokens", "weight", "fp", "drawn", "ids", "spans"))))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, clash):
            out = stage(spark, given, data)
            assert out.columns == given.columns, name
            kept = [r.doc_id for r in out.collect()]
            if name == "near_duplicates":
                assert sorted(kept, key=str) == sorted([1, None, 3, 3, 4, 4], key=str) or sorted(kept, key=str) == sorted([1, None, 2, 3, 3, 4, 4], key=str)
            if name == "pii":
                assert len(kept) == len(rows)
        assert stage(spark, docs.where("false"), data).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1]
    assert sorted(r.n_tokens for r in last(spark, docs, data).collect())[:2] == [0, 0] and last(spark, docs.where("false"), data).count() == 0


def test_pipeline_keeps_one_of_each_group(spark, data):
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(300))
    rows = [(1, long), (2, long), (3, long.replace("w7 ", "q7 ")), (4, "another text altogether with its own words")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, data).collect()} == {1, 4}


def test_every_operator_is_registered():
    from loomgraph.llm import registry

    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
