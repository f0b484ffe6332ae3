"""Toxicity: undo character tricks with a noisy-channel decoder, then score the restored text.

A character language model is counted over all documents: trigrams of folded letters, one bounded
table whatever the corpus, summed map-side. A written token is a lattice: a digit or sign may stand
for the letters it resembles, may have been put in between, or may be itself; a letter repeated
three times or more may be meant once or twice. A run of single characters with gaps between them is
one lattice too, in which every gap may be dropped or may part two words, at a price that depends on
whether it is the run's usual gap: so `a n i d i o t` is two words. Where gaps part words, the reading
without any gap counts as well. Viterbi decoding finds the
cheapest path under the language model and the channel's costs. Only tokens and runs with such
traits are decoded; others restore to themselves.

The restored tokens and their beginnings are the features of a logistic regression. It is fitted on
at most `TRAIN` labelled rows (those first in a hash order of doc_id among rows whose crc32(doc_id
as text) mod 5 is not 0); labels, lang, source and doc_id are no inputs of a score. Weights travel
in the closure: at most `KEPT` numbers.

Scoring is one narrow pass over whole texts. Workers cache what a token contributes, up to a bound.

Defined edge cases: null and empty texts have no features and get the intercept's score; without
labelled rows, or with one class only, every text gets the smoothed rate of class 1; a doc_id
labelled twice counts as toxic if any label says so, null labels are left out; repeated rows get
equal scores; further columns are ignored or, in `drop_toxic`, kept.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, table

#: Labelled rows fitted on; features looked at (a power of two); features kept.
TRAIN, BUCKETS, KEPT = 8000, 1 << 18, 4000
#: Cached tokens of a worker, held-out fold.
CACHE, FOLDS = 500_000, 5

#: Letters of the language model; symbol 0 is any other character, the last one any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêëàâçñóíáúîïôûù"
SYMBOLS = len(LETTERS) + 2
OTHER = SYMBOLS - 1

#: What a written sign may stand for: fixed values.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "+": "t", "|": "li", "(": "c", "€": "e", "£": "l", "¡": "i", "ø": "o",
}
#: Costs of the channel, in nats: substitution, insertion of a sign, keeping it, repetition.
SUBSTITUTED, INSERTED, MEANT, REPEATED = 1.0, 0.7, 2.5, 0.5

#: Costs of a run's usual gap and of any other one: dropped, and kept as the end of a word.
GAP, OTHER_GAP = (0.2, 2.5), (1.5, 0.3)

EDGES = ".,;:?\"'()[]{}%#*&|~`<>/\\-_="
TRIPLE = re.compile(r"([^\W\d_])\1\1")
_SINGLE, _BETWEEN = r"[^\W_]|[@$!+|(€£¡]", r"[\s.\-*_,/~:;]"
#: Three single characters or more with gaps between them; no character is both, so matching is linear.
GAPPED = re.compile(rf"(?<![^\s\"'\[])(?:{_SINGLE})(?:{_BETWEEN}+(?:{_SINGLE})){{2,}}(?![^\s.,;:?\"')\]])")
PARTS = re.compile(rf"({_BETWEEN}+)")

#: Signs that stand for no letter and may join words.
JOINERS = re.compile(r"[^\w@$!+|(€£¡]|_")


def _symbol_table() -> np.ndarray:
    """Symbol of each code point below 0x3000; letters beyond are OTHER."""
    out = np.zeros(0x3000, np.int64)
    for cp in range(0x3000):
        c = chr(cp).lower()
        if len(c) == 1 and c in LETTERS:
            out[cp] = 1 + LETTERS.index(c)
        elif unicodedata.category(chr(cp)).startswith("L"):
            out[cp] = OTHER
    return out


_TABLE = _symbol_table()


def symbols(text: str) -> np.ndarray:
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(cps < 0x3000, _TABLE[np.minimum(cps, 0x2FFF)], OTHER)


def count_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts over every text, padded by two boundaries on either side: SYMBOLS ** 3 numbers."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            held: list[str] = []
            size = 0
            for t in [*batch.column(0), None]:
                s = t.as_py() if t is not None else None
                if s:
                    held.append(s)
                    size += len(s)
                if held and (size > 1 << 20 or t is None):
                    x = symbols("  " + "  ".join(held) + "  ")
                    total += np.bincount((x[:-2] * SYMBOLS + x[1:-1]) * SYMBOLS + x[2:], minlength=SYMBOLS**3)
                    held, size = [], 0
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    got = docs.select(text).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SYMBOLS**3, np.int64)
    out[got["id"].to_numpy()] = got["n"].to_numpy()
    return out


class CharModel:
    """Interpolated trigram costs in nats, as one table of SYMBOLS ** 3 numbers."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 1) / (c1.sum() + SYMBOLS)
        p2 = (c2 + 20 * p1[None, :]) / (c2.sum(1, keepdims=True) + 20)
        p3 = (c3 + 10 * p2[None, :, :]) / (c3.sum(2, keepdims=True) + 10)
        self.cost = (-np.log(p3)).astype(np.float32)

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """For each stretch of a written token, what it may stand for and at which cost."""
        out: list[list[tuple[str, float]]] = []
        i = 0
        while i < len(token):
            c = token[i]
            j = i
            while j < len(token) and token[j] == c:
                j += 1
            n = j - i
            if c.isalpha() and c not in LOOKS:
                if n >= 3:
                    out.append([(c, REPEATED), (c + c, REPEATED)])
                else:
                    out += [[(c, 0.0)]] * n
            else:
                ways = [(x, SUBSTITUTED) for x in LOOKS.get(c, "")]
                if not c.isdigit():
                    ways.append(("", INSERTED))
                ways.append((" ", MEANT))
                out.append(ways) if n > 1 and not c.isdigit() else out.extend([ways] * n)
            i = j
        return out

    def gapped(self, run: str) -> list[list[tuple[str, float]]]:
        """The lattice of single characters with gaps."""
        parts = PARTS.split(run)
        gaps = parts[1::2]
        usual = min(Counter(gaps).items(), key=lambda g: (-g[1], len(g[0]), g[0]))[0]
        out: list[list[tuple[str, float]]] = []
        for i, part in enumerate(parts):
            if i % 2:
                dropped, kept = GAP if part == usual else OTHER_GAP
                out.append([("", dropped), (" ", kept)])
            else:
                out += self.lattice(part)
        return out

    def decode(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The cheapest text of a lattice, in time linear in it; blanks part words."""
        cost, table = self.cost, _TABLE
        # a state's text is a chain of words, the last first
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for ways in [*lattice, [(" ", 0.0)]]:
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (paid, text) in states.items():
                for word, price in ways:
                    x, y, total = a, b, paid + price
                    for c in word:
                        z = int(table[ord(c)]) if ord(c) < 0x3000 else OTHER
                        total += float(cost[x, y, z])
                        x, y = y, z
                    if (x, y) not in after or total < after[x, y][0]:
                        after[x, y] = (total, (text, word) if word else text)
            states = after

        def spelt(chain: tuple) -> str:
            words = []
            while chain:
                chain, word = chain
                words.append(word)
            return "".join(reversed(words))

        least = min(paid for paid, _ in states.values())
        return min(spelt(chain) for paid, chain in states.values() if paid == least).strip()

    def restore(self, token: str) -> str:
        """A lower-case token as it was meant: itself unless it shows signs of disguise."""
        token = token.strip(EDGES)
        if token.isalpha() and not TRIPLE.search(token):
            return token
        if len(token) > 1 and token[-1] in "$!+" and token[-2] == token[-1]:
            token = token.rstrip(token[-1]).strip(EDGES)
        if token.isalpha() and not TRIPLE.search(token):
            return token
        letters = sum(c.isalpha() for c in token)
        if letters == 0 or len(token) < 3:
            return token
        return self.decode(self.lattice(token))

    def spelled(self, text: str) -> Iterator[str]:
        """Words written with gaps between their letters, restored."""
        for m in GAPPED.finditer(text):
            letters = {c for c in m.group() if c.isalpha()}
            if len(letters) > 1:
                lattice = self.gapped(m.group())
                read = self.decode(lattice)
                yield read
                if " " in read:  # the second reading: every gap dropped
                    yield self.decode([[w for w in ways if w[0] != " "] or ways for ways in lattice])


def _hashed(word: str) -> list[int]:
    """Feature numbers of a restored word: itself and its beginnings of four to six letters."""
    raw = [word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) > n)]
    return [zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in raw]


class _Tokens(dict):
    """Features of a written token, computed once while the cache has room."""

    def __init__(self, model: CharModel, keep: np.ndarray | None):
        super().__init__()
        self.model, self.keep = model, keep

    def __missing__(self, token: str) -> tuple[int, ...]:
        found = set()
        restored = self.model.restore(token).split()
        parts = JOINERS.split(token.strip(EDGES))
        if len(parts) > 1:  # words joined by signs, besides one word with signs put in
            restored += [w for p in parts if len(p) >= 3 for w in self.model.restore(p).split()]
        for word in restored:
            if len(word) >= 3:
                found.update(_hashed(word))
        if self.keep is not None:
            found = {f for f in found if self.keep[f]}
        out = tuple(found)
        if len(token) <= 48:
            if len(self) >= CACHE:
                self.clear()
            self[token] = out
        return out


def doc_features(text: str, tokens: _Tokens) -> set[int]:
    low = text.lower()
    found: set[int] = set()
    for token in set(low.split()):
        got = tokens[token]
        if got:
            found.update(got)
    for word in tokens.model.spelled(low):
        for w in word.split():
            if len(w) >= 3:
                found.update(f for f in _hashed(w) if tokens.keep is None or tokens.keep[f])
    return found


class Scorer:
    """Weights of hashed features and an intercept."""

    def __init__(self, model: CharModel, weights: np.ndarray, bias: float):
        self.model, self.weights, self.bias = model, weights, bias

    @classmethod
    def fit(cls, model: CharModel, rows: list[np.ndarray], y: np.ndarray) -> Scorer:
        weights = np.zeros(BUCKETS, np.float32)
        rate = (y.sum() + 0.5) / (len(y) + 1.0)
        bias = math.log(rate / (1 - rate))
        if len(y) == 0 or y.min() == y.max():
            return cls(model, weights, bias)
        doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        feat = np.concatenate(rows).astype(np.int64)
        n1 = np.bincount(feat, y[doc], BUCKETS)
        n0 = np.bincount(feat, 1.0 - y[doc], BUCKETS)
        odds = np.log((n1 + 0.3) / (y.sum() + 0.6)) - np.log((n0 + 0.3) / ((1 - y).sum() + 0.6))
        worth = np.abs(odds) / np.sqrt(1 / (n1 + 0.3) + 1 / (n0 + 0.3))
        worth[n1 + n0 < 3] = 0
        kept = np.argsort(-worth, kind="stable")[:KEPT]
        kept = kept[worth[kept] > 1.5]
        place = np.full(BUCKETS, -1)
        place[kept] = np.arange(len(kept))
        ok = place[feat] >= 0
        doc, feat = doc[ok], place[feat[ok]]
        w, v, step = np.zeros(len(kept)), np.zeros(len(kept)), np.zeros(len(kept))
        for i in range(1, 401):  # Adam, full batch
            p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, w[feat], len(y)) + bias, -40, 40)))
            r = p - y
            g = np.bincount(feat, r[doc], len(kept)) + 0.3 * w
            step, v = 0.9 * step + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.05 * (step / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
            bias -= 0.5 * r.mean() / max(1e-3, (p * (1 - p)).mean())
        weights[kept] = w
        return cls(model, weights, float(bias))

    def tokens(self) -> _Tokens:
        return _Tokens(self.model, self.weights != 0)

    def score(self, text: str, tokens: _Tokens) -> float:
        total = self.bias + sum(float(self.weights[f]) for f in sorted(doc_features(text, tokens)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, total))))


def folded(key: str = "doc_id"):
    """True for rows held out of learning: crc32 of the key as text is divisible by FOLDS."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Scorer:
    """A scorer for `docs` whose labels are in `labels` (key, toxic)."""
    ready(docs.sparkSession)
    model = CharModel(count_trigrams(docs, text))
    known = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull() & ~folded(key))
    known = known.groupBy(key).agg(F.max("toxic").alias("_y"))
    there = known.join(docs.select(key).distinct(), key, "left_semi")
    picked = there.orderBy(F.xxhash64(key), key).limit(TRAIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens(model, None)
        for batch in batches:
            found = [sorted(doc_features(t.as_py() or "", tokens)) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], names=["f", "y"])

    # at most TRAIN keys; one row of each: the least text
    sample = docs.select(key, text).join(F.broadcast(picked), key).groupBy(key).agg(F.min(text).alias(text), F.first("_y").alias("_y")).select(text, "_y")
    got = sample.mapInArrow(run, "f array<int>, y int").toArrow()
    y = got["y"].to_numpy().astype(float)
    return Scorer.fit(model, [np.asarray(f.values) for f in got["f"]], y)


def score(docs: DataFrame, scorer: Scorer, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with a column `out` between 0 and 1; `out` must be a new name."""
    ready(docs.sparkSession)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = scorer.tokens()
        for batch in batches:
            scores = pa.array([scorer.score(t.as_py() or "", tokens) for t in batch.column(place)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, out])

    columns = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{columns}, `{out}` double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that score below `threshold`, all columns kept."""
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    kept = score(docs, train(docs, labels), out=name)
    return kept.where(F.col(name) < threshold).select(*docs.columns)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score."""
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", folded().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
