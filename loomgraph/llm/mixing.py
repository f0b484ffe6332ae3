"""Mixing by iterative proportional fitting: token weights raked to three marginals, then sampling.

Documents fall into cells of (source, language, topic). Token totals of the cells are raked, one
marginal after the other, until the tokens that are drawn of every source, language and topic meet
their targets: a cell's weight is the product of one factor for each of its groups, its probability
that weight cut at 1, and each factor is set from what the cut probabilities draw. So cells that are
drawn whole stay at 1 and the other cells of their groups make up for them; the draws meet the
marginals, not only the weights. A document stays if a hash of its key, read as a number in [0, 1),
is below its cell's probability: no coin is thrown twice, whatever is recomputed.

The expected tokens kept are `BUDGET` of all, or the largest share below it that the tables can
give: a group cannot be drawn more than whole, so the budget starts at the least ratio of a group's
tokens to its target and is lowered by a tenth at a time while the marginals stay more than `FIT`
off. Where no budget fits (a source of one language whose targets contradict each other), the first
one is kept and raking ends as near as it comes.

Topics are clusters of word usage: centroids of hashed word shares by `LLOYD` rounds over all
documents, started from `SAMPLE` rows (those first in a hash order of the key). Shares are kept as
bytes and their sums are whole numbers, so neither partitioning nor order changes a topic. Targets:
a source's and a topic's share are its token shares to the powers `SOURCE_POWER` and `TOPIC_POWER`,
renormalised; languages have `LANG_TARGETS`, any other sharing `REST` by tokens. No target is more
than `LIFT` times a group's own share; what that takes away goes to the other groups in proportion,
so a small group does not decide how little of all others is kept.

One pass reads the texts and leaves `WIDTH` bytes a document; cells are summed map-side, so a source
with a third of all rows is a few numbers a task. The cell table is raked on the driver while it has
at most `MAX_CELLS` rows and by the same steps as checkpointed DataFrames beyond; probabilities reach
documents by a join on the cell that is broadcast up to `SENT_CELLS` and that Spark may split where
skewed.

Defined edge cases: null source, language and topic are groups of their own; null and empty texts
have no tokens, and take their cell's probability; a null key hashes like any value; repeated rows
share one fate; an empty table gives an empty result; further columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, saved, table

TOPICS, SAMPLE, WIDTH, LLOYD = 8, 2000, 256, 10
SOURCE_POWER, TOPIC_POWER, BUDGET = 0.7, 0.7, 0.8
LANG_TARGETS = {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.11}
REST = 0.05
#: How far a target may raise a group above its own share of the tokens.
LIFT = 1.25
#: Rounds of one budget and the change at which they end, rounds without a hundredth of progress, budgets tried, and what fits.
ROUNDS, TOLERANCE, STALLED, TRIES, FIT = 200, 1e-9, 20, 12, 1e-4
#: Cells raked on the driver, cells that a broadcast may carry.
MAX_CELLS, SENT_CELLS = 500_000, 50_000
CACHE = 400_000
#: Groups of a margin up to which its factors are broadcast while large cell tables are raked.
MAX_GROUPS = 100_000


# --- topics ---------------------------------------------------------------------------------


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        import zlib

        at = zlib.crc32(word) % WIDTH
        if len(word) <= 32:
            if len(self) >= CACHE:
                self.clear()
            self[word] = at
        return at


_buckets = _Buckets()


def profile(text: str | None) -> tuple[int, np.ndarray]:
    """Number of words and the square roots of their shares over hashed buckets, as bytes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0, np.zeros(WIDTH, np.uint8)
    counts = np.bincount(np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words)), minlength=WIDTH)
    return len(words), np.rint(np.sqrt(counts / len(words)) * 255).astype(np.uint8)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centroid next to each profile; the first of equally near ones."""
    return (x @ centres.T * 2 - (centres**2).sum(1)).argmax(1)


def _profiles(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDTH).astype(float)


def topic_centres(slim: DataFrame, key: str, topics: int = TOPICS, seed: int = 5) -> np.ndarray:
    """Centroids of all rows of `slim` (key, _profile), started from a sample; fewer where it is smaller."""
    picked = slim.select(F.col(key).alias("_p")).distinct().orderBy(F.xxhash64("_p"), "_p").limit(SAMPLE)
    some = slim.join(F.broadcast(picked), F.col(key).eqNullSafe(F.col("_p"))).groupBy("_p").agg(F.min("_profile").alias("_profile"))
    x = _profiles(pa.array(sorted(some.toArrow()["_profile"].to_pylist()), pa.binary()))  # at most SAMPLE rows
    if not len(x):
        return np.zeros((1, WIDTH))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(topics, len(x)), replace=False)]
    for _ in range(25):
        near = nearest(x, centres)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = x[near == c].mean(0)
    for _ in range(LLOYD):
        now = centres

        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(now), WIDTH + 1), np.int64)
            for batch in batches:
                x = _profiles(batch.column(0))
                near = nearest(x, now)
                for c in range(len(now)):
                    total[c, :WIDTH] += x[near == c].sum(0).astype(np.int64)
                    total[c, WIDTH] += int((near == c).sum())
            topic, dim = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(topic), pa.array(dim), pa.array(total[topic, dim])], names=["t", "d", "s"])

        got = slim.select("_profile").mapInArrow(sums, "t long, d long, s long").groupBy("t", "d").agg(F.sum("s").alias("s")).toArrow()
        total = np.zeros((len(now), WIDTH + 1))  # at most TOPICS * (WIDTH + 1) rows came
        total[got["t"].to_numpy(), got["d"].to_numpy()] = got["s"].to_numpy()
        held = total[:, WIDTH] > 0
        centres = np.where(held[:, None], total[:, :WIDTH] / np.maximum(total[:, WIDTH:], 1), now)
        if (centres == now).all():
            break
    return centres


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, source, lang, `_topic` and `_tokens` of every row."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profile(t.as_py()) for t in batch.column(3)]
            tokens = pa.array([n for n, _ in found], pa.int64())
            shares = pa.array([p.tobytes() for _, p in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], tokens, shares], names=[key, "source", "lang", "_tokens", "_profile"])

    kinds = dict(docs.dtypes)
    columns = f"`{key}` {kinds[key]}, source {kinds['source']}, lang {kinds['lang']}, _tokens long"
    slim = saved(docs.select(key, "source", "lang", text).mapInArrow(run, f"{columns}, _profile binary"))
    centres = topic_centres(slim, key)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            topic = pa.array(nearest(_profiles(batch.column(4)), centres).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], topic], names=[key, "source", "lang", "_tokens", "_topic"])

    return slim.mapInArrow(assign, f"{columns}, _topic int")


# --- raking ---------------------------------------------------------------------------------


def targets(names: list, tokens: np.ndarray, power: float | None) -> np.ndarray:
    """Target share of each group of a marginal; `power` None means the language table."""
    if power is not None:
        wish = tokens**power
    else:
        wish = np.array([LANG_TARGETS.get(n, 0.0) for n in names])
        rest = np.where(wish == 0, tokens, 0.0)
        if rest.sum() > 0:
            wish = wish + REST * rest / rest.sum()
    most = LIFT * tokens / max(tokens.sum(), 1e-300)
    rate = 1 / wish.sum()
    while True:  # each turn holds more groups at their bound
        held = rate * wish >= most
        free = wish[~held].sum()
        now = (1 - most[held].sum()) / free if free > 0 else rate
        if now <= rate * (1 + 1e-12):
            return np.minimum(rate * wish, most) / np.minimum(rate * wish, most).sum()
        rate = now


class Cells:
    """Cells held as arrays: `tokens`, and for each margin every cell's group and the groups' goals."""

    def __init__(self, tokens: np.ndarray, groups: list[np.ndarray], goals: list[np.ndarray]):
        self.tokens, self.groups, self.goals = tokens, groups, goals
        self.total = tokens.sum()

    def room(self) -> float:
        """The largest budget at which no single group has to be drawn more than whole."""
        sums = [np.bincount(g, self.tokens, len(goal)) for g, goal in zip(self.groups, self.goals, strict=True)]
        return min(float((s[goal > 0] / goal[goal > 0]).min(initial=self.total)) / self.total for s, goal in zip(sums, self.goals, strict=True))

    def start(self, budget: float) -> None:
        self.weights = np.full(len(self.tokens), budget)

    def round(self, budget: float) -> float:
        """Set the factors of every margin in turn; the largest relative change."""
        off = 0.0
        for g, goal in zip(self.groups, self.goals, strict=True):
            have = np.bincount(g, np.minimum(1, self.weights) * self.tokens, len(goal)) / self.total
            step = np.divide(goal * budget, have, out=np.ones_like(goal), where=have > 0)
            off = max(off, float(np.abs(step[(goal > 0) & (have > 0)] - 1).max(initial=0.0)))
            self.weights = np.minimum(self.weights * step[g], 1e12)
        return off


def rake(cells: Cells, budget: float = BUDGET) -> float:
    """Fit the weights of `cells`; the budget that its marginals allow."""
    first = min(budget, cells.room())
    for attempt in range(TRIES + 1):
        now = first * 0.9**attempt if attempt < TRIES else first  # nothing fits: as near as the first one comes
        cells.start(now)
        offs: list[float] = []
        for _ in range(ROUNDS):
            offs.append(cells.round(now))
            if offs[-1] < TOLERANCE or (len(offs) > STALLED and offs[-1] > 0.99 * offs[-1 - STALLED]):
                break
        if offs[-1] <= FIT:
            break
    return now


MARGINS = (("source", SOURCE_POWER), ("lang", None), ("_topic", TOPIC_POWER))


def weigh(cells: DataFrame) -> DataFrame:
    """`cells` (source, lang, _topic, _tokens) with `weight` and `probability`."""
    if cells.limit(MAX_CELLS + 1).count() > MAX_CELLS:
        return _weigh_large(cells)
    rows = sorted(cells.collect(), key=lambda r: tuple((r[m] is not None, r[m]) for m, _ in MARGINS))
    tokens = np.array([float(r["_tokens"]) for r in rows])
    weights = np.ones(len(rows))
    if tokens.sum() > 0:
        groups, goals = [], []
        for m, power in MARGINS:
            names = list(dict.fromkeys(r[m] for r in rows))
            at = {n: i for i, n in enumerate(names)}
            g = np.array([at[r[m]] for r in rows])
            groups.append(g)
            goals.append(targets(names, np.bincount(g, tokens, len(names)), power))
        held = Cells(tokens, groups, goals)
        rake(held)
        weights = held.weights
    data = [(r["source"], r["lang"], r["_topic"], float(w), float(min(1.0, w))) for r, w in zip(rows, weights, strict=True)]
    kinds = dict(cells.dtypes)
    return cells.sparkSession.createDataFrame(data, f"source {kinds['source']}, lang {kinds['lang']}, _topic int, weight double, probability double")


class FrameCells:
    """The same for more cells than the driver should hold: every step is a grouped sum."""

    def __init__(self, cells: DataFrame):
        self.cells = cells
        self.total = float(cells.agg(F.sum("_tokens")).first()[0] or 1)
        self.goals: dict[str, DataFrame] = {}
        for m, power in MARGINS:
            sums = cells.groupBy(m).agg(F.sum("_tokens").cast("double").alias("_t"))
            if power is not None:
                sums = sums.withColumn("_g", F.pow("_t", F.lit(power)))
            else:
                known = F.create_map(*[F.lit(x) for kv in LANG_TARGETS.items() for x in kv])
                named = F.coalesce(known[F.col(m)], F.lit(0.0))
                rest = sums.where(named == 0).agg(F.sum("_t")).first()[0] or 1.0
                sums = sums.withColumn("_g", F.when(named > 0, named).otherwise(F.col("_t") * REST / rest))
            most = F.col("_t") * LIFT / self.total
            rate = 1 / (sums.agg(F.sum("_g")).first()[0] or 1.0)
            while True:
                held = F.col("_g") * rate >= most
                at, free = sums.agg(F.sum(F.when(held, most)), F.sum(F.when(~held, F.col("_g")))).first()
                now = (1 - (at or 0.0)) / free if free else rate
                if now <= rate * (1 + 1e-12):
                    break
                rate = now
            sums = sums.withColumn("_g", F.least(F.col("_g") * rate, most))
            whole = sums.agg(F.sum("_g")).first()[0] or 1.0
            self.goals[m] = saved(sums.select(m, "_t", (F.col("_g") / whole).alias("_g")))
        self.few = {m: g.count() <= MAX_GROUPS for m, g in self.goals.items()}

    def room(self) -> float:
        least = [g.where("_g > 0").agg(F.min(F.col("_t") / F.col("_g"))).first()[0] for g in self.goals.values()]
        return min(self.total if x is None else x for x in least) / self.total

    def start(self, budget: float) -> None:
        # a weight is the product of one factor of each margin; a round makes three small tables of factors
        self.budget = budget
        self.factors = {m: g.withColumn("_f", F.lit(1.0)) for m, g in self.goals.items()}

    def _sent(self, df: DataFrame, m: str) -> DataFrame:
        return F.broadcast(df) if self.few[m] else df

    def weighed(self) -> DataFrame:
        at = self.cells.withColumn("weight", F.lit(self.budget))
        for m, factors in self.factors.items():
            f = self._sent(factors.select(F.col(m).alias("_m"), "_f"), m)
            at = at.join(f, at[m].eqNullSafe(f["_m"])).withColumn("weight", F.least(F.lit(1e12), F.col("weight") * F.col("_f"))).drop("_m", "_f")
        return at

    def round(self, budget: float) -> float:
        off = 0.0
        for m in self.goals:
            drawn: Column = F.least(F.lit(1.0), F.col("weight")) * F.col("_tokens")
            have = self._sent(self.weighed().groupBy(F.col(m).alias("_m")).agg((F.sum(drawn) / F.lit(self.total)).alias("_h")), m)
            step = F.when(F.col("_h") > 0, F.col("_g") * budget / F.col("_h")).otherwise(1.0)
            old = self.factors[m].select(m, "_g", "_f")
            new = old.join(have, old[m].eqNullSafe(have["_m"])).select(m, "_g", (F.col("_f") * step).alias("_f"), F.when(F.col("_h") > 0, F.abs(step - 1)).alias("_o"))
            self.factors[m] = saved(new)
            off = max(off, self.factors[m].where("_g > 0").agg(F.max("_o")).first()[0] or 0.0)
        return off


def _weigh_large(cells: DataFrame) -> DataFrame:
    held = FrameCells(cells)
    rake(held)
    return saved(held.weighed()).select("source", "lang", "_topic", "weight", F.least(F.lit(1.0), F.col("weight")).alias("probability"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, source, lang, topic, tokens, weight, probability and whether it is drawn."""
    slim = saved(measured(docs, key, text))
    cells = slim.groupBy("source", "lang", "_topic").agg(F.sum("_tokens").alias("_tokens"))
    weights = weigh(saved(cells)).withColumnsRenamed({"source": "_s", "lang": "_l", "_topic": "_t"})
    if weights.limit(SENT_CELLS + 1).count() <= SENT_CELLS:
        weights = F.broadcast(weights)
    same = F.col("source").eqNullSafe(F.col("_s")) & F.col("lang").eqNullSafe(F.col("_l")) & (F.col("_topic") == F.col("_t"))
    # the hash as a number in [0, 1)
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit("draw"), F.col(key)), 11)).cast("double") / F.lit(float(1 << 53))
    return slim.join(weights, same).select(
        key, "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"), "weight", "probability",
        (draw < F.col("probability")).alias("drawn"),
    )


def sample(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of `docs` that are drawn, all columns kept."""
    name = "_drawn"
    while name in docs.columns:
        name += "_"
    drawn = mix(docs, key).where("drawn").select(F.col(key).alias(name)).distinct()
    return docs.join(drawn, docs[key].eqNullSafe(F.col(name)), "left_semi")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cell, weight, probability and whether it is drawn."""
    return mix(table(ready(spark), sf_dir, "documents"))
