"""BM25: all scores by joins, or the best of each query with no row for a pair."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

K1, B = 1.2, 0.75
#: Words of queries that travel to the executors; documents and queries that a task scores at once.
ASKED, DOCS, QUERIES = 1_000_000, 4096, 512


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def bm25(queries: DataFrame, docs: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(q, d, score) for each query text and document that share a word.

    `queries` has (q, text), `docs` (d, text). Null documents count in the corpus with no words.
    A query's repeated words count once each time. Term statistics aggregate before they shuffle;
    documents meet queries by word only, and only words that some query has.
    """
    asked = queries.select("q", F.explode(words(F.col("text"))).alias("w")).groupBy("q", "w").agg(F.count(F.lit(1)).alias("qf"))
    lengths = docs.select("d", F.size(words(F.col("text"))).alias("n"), words(F.col("text")).alias("ws"))
    stats = lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"))
    terms = lengths.select("d", "n", F.explode("ws").alias("w")).join(asked.select("w").distinct(), "w", "left_semi")
    tf = terms.groupBy("w", "d", "n").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    weighted = tf.join(df, "w").crossJoin(F.broadcast(stats))  # stats is one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    share = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return (
        weighted.select("w", "d", (idf * share).alias("s"))
        .join(asked, "w")
        .groupBy("q", "d")
        .agg(F.sum(F.col("s") * F.col("qf")).alias("score"))
    )


def best(queries: DataFrame, docs: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """(q, d, score) with the k best documents of every query among the rows; equal scores go to the smaller d.

    The words that queries ask for travel to the documents, where they lie: one pass counts in how many
    documents each word is, a second scores and keeps k documents a query and partition. Only those are
    shuffled. Words of queries beyond `ASKED`, or keys that documents share, take the joins of `bm25`.
    """
    found = queries.where("q IS NOT NULL").select("q", F.explode(words(F.col("text"))).alias("w")).groupBy("q", "w").agg(F.count(F.lit(1)).alias("qf"))
    asked = found.limit(ASKED + 1).toArrow()
    if not 0 < asked.num_rows <= ASKED or not docs.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return bm25(queries, docs, k1, b)
    vocabulary = pc.unique(asked["w"].combine_chunks())
    names = pc.unique(asked["q"].combine_chunks())
    of_word = pc.index_in(asked["w"], value_set=vocabulary).to_numpy()
    of_query = pc.index_in(asked["q"], value_set=names).to_numpy()
    order = np.lexsort((of_query, of_word))
    of_word, of_query, times = of_word[order], of_query[order], asked["qf"].to_numpy()[order].astype(float)
    starts = np.searchsorted(of_word, np.arange(len(vocabulary) + 1))
    terms = docs.select("d", words(F.col("text")).alias("ws"))
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary.to_pylist(), names.to_pylist(), starts, of_query, times))

    def counted(ws: Any, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; and document, word and count of those asked for, by word and document."""
        n = pc.list_value_length(ws).to_numpy(zero_copy_only=False).astype(np.int64)
        at = pc.fill_null(pc.index_in(ws.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        pair = (at * len(n) + np.repeat(np.arange(len(n)), n))[at >= 0]
        pair, tf = np.unique(pair, return_counts=True)
        return n, pair % max(1, len(n)), pair // max(1, len(n)), tf

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value[0], pa.string())
        have, rows, total = np.zeros(len(known), np.int64), 0, 0
        for whole in batches:
            for i in range(0, whole.num_rows, DOCS):
                n, _, w, _ = counted(whole.slice(i, DOCS)["ws"], known)
                have += np.bincount(w, minlength=len(known))
                rows, total = rows + len(n), total + int(n.sum())
        some = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2]).astype(np.int64)), pa.array(np.append(have[some], [rows, total]).astype(np.int64))], ["w", "n"])

    got = terms.mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    have = dict(zip(got["w"], got["n"], strict=True))
    size, total = have.pop(-1, 0), have.pop(-2, 0)
    df = np.zeros(len(vocabulary))
    df[list(have)] = list(have.values())
    idf, mean = np.log(1 + (size - df + 0.5) / (df + 0.5)), total / max(1, size)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, asking, starts, of_query, times = sent.value
        known = pa.array(texts, pa.string())
        kept: list[list[tuple[float, Any]]] = [[] for _ in asking]
        kind = None
        for whole in batches:
            for i in range(0, whole.num_rows, DOCS):
                part = whole.slice(i, DOCS)
                part = part.take(pc.sort_indices(part["d"]))  # so that of equal scores the first is the one wanted
                kind, d = part["d"].type, part["d"]
                n, at, w, tf = counted(part["ws"], known)
                share = idf[w] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * n[at] / mean)))
                cuts = [*np.flatnonzero(np.diff(w, prepend=-1)), len(w)]
                for low in range(0, len(asking), QUERIES):
                    sums = np.zeros((min(QUERIES, len(asking) - low), len(n)))
                    for x, y in zip(cuts, cuts[1:], strict=False):
                        s, e = starts[w[x]], starts[w[x] + 1]
                        s, e = s + np.searchsorted(of_query[s:e], [low, low + QUERIES])
                        for q, qf in zip(of_query[s:e] - low, times[s:e], strict=True):
                            sums[q, at[x:y]] += share[x:y] * qf
                    for q, row in enumerate(sums):
                        mine = kept[low + q]
                        bar = np.partition(row, -k)[-k] if k < len(row) else 0.0
                        bar = max(bar, mine[-1][0] if len(mine) == k else 0.0)
                        some = np.flatnonzero((row >= bar) & (row > 0))
                        if len(some):
                            some = some[np.argsort(-row[some], kind="stable")[:k]]
                            both = mine + list(zip(row[some].tolist(), d.take(pa.array(some)).to_pylist(), strict=True))
                            kept[low + q] = sorted(both, key=lambda z: (-z[0], z[1]))[:k]
        if kind is not None:
            rows = [(name, y, x) for name, mine in zip(asking, kept, strict=True) for x, y in mine]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], asked_kind), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.float64())], ["q", "d", "score"])

    asked_kind = names.type
    schema = T.StructType([T.StructField("q", queries.schema["q"].dataType), T.StructField("d", docs.schema["d"].dataType), T.StructField("score", T.DoubleType())])
    return terms.where("d IS NOT NULL").mapInArrow(score, schema)
