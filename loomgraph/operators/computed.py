"""Relationships that are worked out from node properties: theta, as-of, top-k and text search."""

from __future__ import annotations

import re
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SemanticFault
from ..functions import text
from ..functions.registry import dot
from ..sources.mapping import ComputedMapping, NodeMapping
from .asof import asof


def sides(graph: Any, e: ComputedMapping) -> tuple[DataFrame, DataFrame, NodeMapping, NodeMapping]:
    """Sources as `_a` and `a_` properties, targets as `_b` and `b_` properties, and their mappings."""
    a, b = (graph.rows(graph.mapping.node(x)) for x in (e.source, e.target))
    ma, mb = graph.mapping.node(e.source), graph.mapping.node(e.target)
    if len(ma.key) != 1 or len(mb.key) != 1:
        raise SemanticFault(f"{e.type}: computed relationships need single-column keys")
    left = a.select(*(F.col(f"`{c}`").alias(f"a_{p}") for p, c in ma.properties.items()), F.col(f"`{ma.key[0]}`").alias("_a"))
    right = b.select(*(F.col(f"`{c}`").alias(f"b_{p}") for p, c in mb.properties.items()), F.col(f"`{mb.key[0]}`").alias("_b"))
    return left, right, ma, mb


def pairs(graph: Any, e: ComputedMapping) -> tuple[DataFrame, dict[str, Column]]:
    """Rows `_a`, `_b` (keys of source and target) and the properties they carry."""
    left, right, _, _ = sides(graph, e)
    o = e.options
    if e.kind == "predicate":
        on = F.expr(o["on"].replace("a.", "a_").replace("b.", "b_"))
        return left.join(right, on).select("_a", "_b"), {}
    if e.kind == "as_of":
        by = o.get("partition", [])
        df = asof(left, right, f"a_{o['source_time']}", f"b_{o['target_time']}", [f"a_{x}" for x, _ in by], [f"b_{y}" for _, y in by], "_b", bool(o.get("cut")))
        return df.select("_a", "_b"), {}
    if e.kind == "top_k":
        return _top_k(left, right, e.source == e.target, o), {"score": F.col("score"), "rank": F.col("rank")}
    if e.kind == "search":
        q, d = o["text"]
        k = int(o.get("k", 10))
        found = text.best(left.select(F.col("_a").alias("q"), F.col(f"a_{q}").alias("text")), right.select(F.col("_b").alias("d"), F.col(f"b_{d}").alias("text")), k)
        w = Window.partitionBy("q").orderBy(F.desc("score"), "d")
        ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        return ranked.select(F.col("q").alias("_a"), F.col("d").alias("_b"), "score", "rank"), {"score": F.col("score"), "rank": F.col("rank")}
    if e.kind == "cypher":
        df = graph.cypher(o["query"], **o.get("parameters", {}))
        if not {"source", "target"} <= set(df.columns):
            raise SemanticFault(f"{e.type}: the query must return source and target")
        extra = {c: F.col(f"`{c}`") for c in df.columns if c not in ("source", "target")}
        return df.withColumnsRenamed({"source": "_a", "target": "_b"}), extra
    raise SemanticFault(f"{e.type}: unknown kind {e.kind!r}")


#: One comparison of a predicate relationship; those with AND between them are counted without their pairs.
TERM = re.compile(r"\s*([ab])\.(\w+)\s*(=|<=|>=|<|>)\s*([ab])\.(\w+)\s*")
FLIP = {"=": "=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
#: Ranges of the compared value in which a count runs, so that no task has all rows of one group.
RANGES = 32


def degrees(graph: Any, e: ComputedMapping, turned: bool) -> DataFrame | None:
    """(`_k`, `_n`): keys of sources and how many targets each has, or of targets and sources if `turned`.

    For predicates that are equalities and at most one inequality between properties of one type;
    None for others. Equal rows of the far side are summed first. With an inequality both sides are
    sorted within the equal values and the range of the compared value, and far rows are summed on
    the way; sums of earlier ranges are added. Numbers and times are cut into ranges at quantiles.
    """
    left, right, ma, mb = sides(graph, e)
    equal: list[tuple[str, str]] = []
    bound: list[tuple[str, str, str]] = []
    for term in re.split(r"\s+AND\s+", e.options["on"], flags=re.IGNORECASE):
        t = TERM.fullmatch(term)
        if t is None or t[1] == t[4]:
            return None
        x, op, y = (t[2], t[3], t[5]) if t[1] == "a" else (t[5], FLIP[t[3]], t[2])
        if x not in ma.properties or y not in mb.properties or left.schema[f"a_{x}"].dataType != right.schema[f"b_{y}"].dataType:
            return None
        if op == "=":
            equal.append((f"a_{x}", f"b_{y}"))
        else:
            bound.append((f"a_{x}", op, f"b_{y}"))
    if len(bound) > 1:
        return None
    mine, theirs, key, far, i = (right, left, "_b", "_a", 1) if turned else (left, right, "_a", "_b", 0)
    by = [f"_g{n}" for n in range(len(equal))]
    kind = left.schema[bound[0][0]].dataType if bound else None
    value = lambda c: F.col(f"`{c}`") + F.lit(0.0).cast(kind) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(f"`{c}`")

    def rows(df: DataFrame, own: str, j: int) -> DataFrame:
        cols = [F.col(f"`{pair[j]}`").alias(g) for g, pair in zip(by, equal, strict=True)]
        cols += [value(bound[0][2 * j]).alias("_x")] if bound else []
        df = df.select(F.col(own).alias("_k"), *cols)
        return df.where(" AND ".join(f"{c} IS NOT NULL" for c in df.columns))

    mine, theirs = rows(mine, key, i), rows(theirs, far, 1 - i)
    if not bound:
        many = theirs.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        return mine.join(many, by).select("_k", "_n")
    op = FLIP[bound[0][1]] if turned else bound[0][1]
    many = theirs.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_c"))
    # far rows that fit come before: greater ones for <, and equal ones unless the comparison is strict
    first = 0 if "=" in op else 1
    both = mine.select(*by, "_x", "_k", F.lit(1 - first).alias("_s"), F.lit(None).cast("long").alias("_c"))
    both = both.unionByName(many.select(*by, "_x", F.lit(None).cast(mine.schema["_k"].dataType).alias("_k"), F.lit(first).alias("_s"), "_c"))
    at = F.unix_micros(F.col("_x").cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.col("_x")
    if isinstance(kind, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        at = at.cast("double")
        cuts = theirs.agg(F.percentile_approx(at, [n / RANGES for n in range(1, RANGES)], F.lit(10 * RANGES)).alias("_cuts"))
        both = both.crossJoin(F.broadcast(cuts)).withColumn("_r", F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c <= at))).drop("_cuts")
    else:
        both = both.withColumn("_r", F.lit(0))
    way = F.desc if "<" in op else F.asc
    w = Window.partitionBy(*by, "_r").orderBy(way("_x"), "_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("_m", F.sum("_c").over(w)).where(F.col("_s") == 1 - first)
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy(way("_r")).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    spans = both.groupBy(*by, "_r").agg(F.sum("_c").alias("_c")).select(*by, "_r", F.sum("_c").over(before).alias("_e"))
    found = inside.join(spans, [*by, "_r"]).select("_k", (F.coalesce("_m", F.lit(0)) + F.coalesce("_e", F.lit(0))).alias("_n"))
    return found.where(F.col("_n") > 0)


#: Targets of a block and sources of a group: what a task holds of each side.
BLOCK, GROUP = 4096, 1024


def _top_k(left: DataFrame, right: DataFrame, loops: bool, o: dict[str, Any]) -> DataFrame:
    """The k targets of best score per source; an optional first stage keeps `candidates` by another vector.

    Targets are dealt into blocks and sources into groups by a hash; each block meets each group once,
    as two matrices, and leaves k rows a source. Work grows with sources times targets: the sources
    should be few or carry a filter (`where`). Vectors that are null, of another length or, for the
    cosine, zero have no score; equal scores go to the smaller target key.
    """
    measure, k = o.get("measure", "cosine"), int(o.get("k", 10))
    if "where" in o:
        left = left.where(F.expr(o["where"].replace("a.", "a_")))
    first, kept = (o["first"], int(o["candidates"])) if "first" in o else (o["vector"], k)
    found = _best(left, right, first, measure, kept, loops)
    if "first" in o:
        x, y = o["vector"]
        u, v = F.col("u").cast("array<double>"), F.col("v").cast("array<double>")
        if measure == "l2":
            score = -F.sqrt(F.aggregate(F.zip_with(u, v, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, t: s + t))
        else:
            score = dot(u, v) if measure == "dot" else dot(u, v) / (F.sqrt(dot(u, u)) * F.sqrt(dot(v, v)))
        pairs = found.select("_a", "_b").join(left.select("_a", F.col(f"a_{x}").alias("u")), "_a").join(right.select("_b", F.col(f"b_{y}").alias("v")), "_b")
        found = pairs.where(F.size("u") == F.size("v")).select("_a", "_b", score.alias("score")).where("score IS NOT NULL AND NOT isnan(score)")
    w = Window.partitionBy("_a").orderBy(F.desc("score"), "_b")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("_a", "_b", "score", "rank")


def _best(left: DataFrame, right: DataFrame, vectors: list[str], measure: str, k: int, loops: bool) -> DataFrame:
    """(_a, _b, score) of the k best targets of every source, by blocks."""
    x, y = vectors
    vector = lambda c: F.col(c).cast("array<double>").alias("v")
    sane = "v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x))"
    a = left.select("_a", vector(f"a_{x}")).where(sane).withColumn("d", F.size("v"))
    b = right.select("_b", vector(f"b_{y}")).where(sane).withColumn("d", F.size("v"))
    blocks, groups = max(1, -(-b.count() // BLOCK)), max(1, -(-a.count() // GROUP))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    a = a.withColumn("g", deal("_a", groups)).withColumn("b", each(blocks))
    b = b.withColumn("b", deal("_b", blocks)).withColumn("g", each(groups))
    kinds = dict(left.dtypes)["_a"], dict(right.dtypes)["_b"]

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)

    def meet(sources: pa.Table, targets: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        if sources.num_rows and targets.num_rows:
            p, q = matrix(sources["v"]), matrix(targets["v"])
            if measure == "cosine":
                p, q = (z / np.where((n := np.sqrt((z * z).sum(1, keepdims=True))) > 0, n, np.nan) for z in (p, q))
            near = p @ q.T
            if measure == "l2":
                near = 2 * near - (q * q).sum(1)
            mine, theirs = sources["_a"].to_pylist(), targets["_b"].to_pylist()
            same = {key: i for i, key in enumerate(theirs)}
            for i, row in enumerate(near):
                row = np.where(np.isnan(row), -np.inf, row)
                if loops and mine[i] in same:
                    row[[j for j, key in enumerate(theirs) if key == mine[i]]] = -np.inf
                bar = np.partition(row, -min(k, len(row)))[-min(k, len(row))]
                some = np.flatnonzero((row >= bar - 1e-9 * (1 + abs(bar))) & (row > -np.inf)) if bar > -np.inf else np.flatnonzero(row > -np.inf)
                # scored again one by one, so that equal vectors have equal scores
                score = -np.sqrt(((q[some] - p[i]) ** 2).sum(1)) if measure == "l2" else (q[some] * p[i]).sum(1)
                order = sorted(range(len(some)), key=lambda j: (-score[j], theirs[some[j]]))[:k]
                take = some[order]
                out.append(pa.table({"_a": pa.array([mine[i]] * len(take), sources["_a"].type), "_b": targets["_b"].take(pa.array(take)).combine_chunks(), "score": score[order]}))
        empty = pa.table({"_a": pa.array([], sources["_a"].type), "_b": pa.array([], targets["_b"].type), "score": pa.array([], pa.float64())})
        return pa.concat_tables(out) if out else empty

    by = ["g", "b", "d"]
    return a.groupBy(*by).cogroup(b.groupBy(*by)).applyInArrow(meet, f"_a {kinds[0]}, _b {kinds[1]}, score double")
