"""Versioned change records: merge, bounded snapshots and continuous subscriptions.

A record is (partition, offset, table, key, version, data): data is JSON text, null a tombstone. For
each (table, key) the greatest version counts; an older one is ignored, a replay of the same version
with the same data too, the same version with other data is an error.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CypherError, PolicyFault, SemanticFault, UnsupportedFault
from ..plans import ast as A
from ..plans import parser
from ..plans.planner import Planner, aggregated

SCHEMA = "partition int, offset long, `table` string, key string, version long, data string"


class ChangeConflict(CypherError):
    code = "ChangeConflict"


def conflicts(changes: DataFrame) -> DataFrame:
    """(table, key, version) that occur with differing data."""
    mark = F.coalesce(F.col("data"), F.lit("\0"))
    found = changes.groupBy("table", "key", "version").agg(F.min(mark).alias("a"), F.max(mark).alias("b"))
    return found.where("a <> b").select("table", "key", "version")


def latest(changes: DataFrame, tombstones: bool = False) -> DataFrame:
    """The current record of each (table, key): one aggregation, combined map-side."""
    top = F.max_by(F.struct("data", "partition", "offset"), F.col("version")).alias("r")
    out = changes.groupBy("table", "key").agg(F.max("version").alias("version"), top)
    out = out.select("table", "key", "version", F.col("r.data").alias("data"), F.col("r.partition").alias("partition"), F.col("r.offset").alias("offset"))
    return out if tombstones else out.where("data IS NOT NULL")


def merge(state: DataFrame, batch: DataFrame) -> DataFrame:
    """`state` with a batch of changes taken in; both have the columns of a record."""
    both = state.unionByName(batch)
    if not conflicts(both).isEmpty():
        raise ChangeConflict("the same version carries different data")
    return latest(both, tombstones=True)


def check_offsets(changes: DataFrame, start: dict[int, int], end: dict[int, int]) -> None:
    """Refuse a log whose partitions or offsets differ from the captured range [start, end)."""
    if set(start) != set(end):
        raise SemanticFault("start and end name different partitions")
    got = {r["partition"]: r for r in changes.groupBy("partition").agg(F.min("offset").alias("lo"), F.max("offset").alias("hi"), F.count_distinct("offset").alias("n")).collect()}
    for p in start:
        want = end[p] - start[p]
        have = got.get(p)
        if want == 0 and have is None:
            continue
        if have is None or have["lo"] != start[p] or have["hi"] != end[p] - 1 or have["n"] != want:
            raise SemanticFault(f"partition {p} has a gap in its log")
    if set(got) - set(start):
        raise SemanticFault("the log has unknown partitions")


def snapshot(log: DataFrame, start: dict[int, int], end: dict[int, int], base: DataFrame | None = None) -> DataFrame:
    """The state at captured offsets, from the log alone or on top of an earlier snapshot."""
    low = F.create_map(*[F.lit(x) for kv in start.items() for x in kv])
    high = F.create_map(*[F.lit(x) for kv in end.items() for x in kv])
    part = log.where((F.col("offset") >= low[F.col("partition")]) & (F.col("offset") < high[F.col("partition")]))
    check_offsets(part, start, end)
    if base is not None:
        return merge(base, part)
    if not conflicts(part).isEmpty():
        raise ChangeConflict("the same version carries different data")
    return latest(part, tombstones=True)


def decoded(records: DataFrame, table: str, schema: T.StructType) -> DataFrame:
    """Rows of one table: key, version and the fields of its JSON data; malformed data is an error."""
    rows = records.where(F.col("table") == table)
    data = F.from_json("data", schema, {"mode": "FAILFAST"})
    return rows.select("key", "version", data.alias("d")).select("key", "version", "d.*")


def subscribe(stream: DataFrame, table: str, schema: T.StructType, where: str, columns: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str, state_path: str):
    """Continuous query over one table: a filter and a projection, one frame per changed key.

    Each micro-batch is merged with the stored state of its keys; the sink gets `key`, `version`,
    `deleted` and the columns. A row that no longer passes the filter, or was removed, comes with
    `deleted` true, so a consumer can retract it. State is a Parquet folder per batch, replaced whole.
    """
    spark = stream.sparkSession

    def on_batch(batch: DataFrame, number: int) -> None:
        mine = batch.where(F.col("table") == table).select("partition", "offset", "table", "key", "version", "data")
        old = f"{state_path}/v{number - 1}"
        try:
            before = spark.read.parquet(old)
        except Exception as e:
            if number > 0:
                raise SemanticFault(f"the state of batch {number - 1} is missing") from e
            before = spark.createDataFrame([], mine.schema)
        after = merge(before.select(mine.columns), mine)
        after.write.mode("overwrite").parquet(f"{state_path}/v{number}")
        after = spark.read.parquet(f"{state_path}/v{number}")
        moved = after.join(before.select("table", "key", F.col("version").alias("_was")), ["table", "key"], "left").where("_was IS NULL OR version > _was")
        typed = moved.select("key", "version", F.from_json("data", schema, {"mode": "FAILFAST"}).alias("d"), F.col("data").isNull().alias("gone"))
        flat = typed.select("key", "version", "gone", "d.*")
        passes = F.coalesce(F.expr(where), F.lit(False)) & ~F.col("gone")
        sink(flat.select("key", "version", (~passes).alias("deleted"), *(F.when(passes, F.col(c)).alias(c) for c in columns)), number)

    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of `events` (ts, event_type, value) by event-time window, late rows dropped by a watermark."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """One row per user and burst of events no more than `gap` apart."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


# --- what may enter and leave a log ---------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """One table of a log: its payload, the permissions it needs, and for an edge where its ends are.

    `edge` is (source table, source field, target table, target field); the fields hold keys.
    """

    schema: T.StructType
    required: tuple[str, ...] = ()
    read: str | None = None
    write: str | None = None
    edge: tuple[str, str, str, str] | None = None


@dataclass(frozen=True)
class Limits:
    """What one snapshot may read, and how long it may take."""

    entities: int = 1_000_000
    records: int = 10_000_000
    seconds: float = 60.0


def validated(records: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """`records`, refused as a whole where a table is unknown, data are malformed or a required field is missing."""
    wrong = ~F.col("table").isin(*rules)
    for name, rule in rules.items():
        fields = T.StructType([*rule.schema.fields, T.StructField("_bad", T.StringType())])
        got = F.from_json("data", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
        bad = got["_bad"].isNotNull()
        for f in rule.required:
            bad = bad | got[f].isNull()
        wrong = wrong | ((F.col("table") == name) & F.col("data").isNotNull() & bad)
    first = records.where(wrong).orderBy("partition", "offset").select("partition", "offset", "table").limit(1).collect()
    if first:
        raise SemanticFault(f"record {first[0]['offset']} of partition {first[0]['partition']} is no valid {first[0]['table']!r}")
    return records


def authorized(records: DataFrame, rules: dict[str, Rule], may: Callable[[str], Any], write: bool = True) -> DataFrame:
    """`records`, refused as a whole unless every permission they need is granted; any error denies."""
    for name in sorted(r["table"] for r in records.select("table").distinct().collect()):  # at most one row a table
        need = None if name not in rules else rules[name].write if write else rules[name].read
        try:
            granted = name in rules and (need is None or may(need) is True)
        except Exception as e:
            raise PolicyFault(f"{need} could not be decided") from e
        if not granted:
            raise PolicyFault(f"{'writing' if write else 'reading'} {name} is denied")
    return records


def visible(state: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """The live records of `state`; an edge only where both its ends are live."""
    live = state.where("data IS NOT NULL")
    for name, rule in rules.items():
        if rule.edge is None:
            continue
        got = F.from_json("data", rule.schema)
        edges, rest = live.where(F.col("table") == name), live.where(F.col("table") != name)
        for table, field in (rule.edge[:2], rule.edge[2:]):
            ends = live.where(F.col("table") == table).select(F.col("key").alias("_end"))
            edges = edges.join(ends, got[field].cast("string") == F.col("_end"), "left_semi")
        live = rest.unionByName(edges)
    return live


def limited(log: DataFrame, start: dict[int, int], end: dict[int, int], limits: Limits = Limits(), base: DataFrame | None = None) -> DataFrame:
    """A snapshot that is refused beyond its limits: records are counted before they are read."""
    began = time.monotonic()
    records = sum(end[p] - start[p] for p in start)
    if records > limits.records:
        raise SemanticFault(f"{records} records, {limits.records} allowed")
    out = snapshot(log, start, end, base)
    entities = out.count()
    if entities > limits.entities:
        raise SemanticFault(f"{entities} entities, {limits.entities} allowed")
    if time.monotonic() - began > limits.seconds:
        raise SemanticFault(f"the snapshot took more than {limits.seconds} s")
    return out


def frames(df: DataFrame, size: int = 4096) -> Iterator[list[Row]]:
    """The rows in frames of at most `size`, one partition at a time on the driver; an empty frame, the heartbeat, ends them."""
    held: list[Row] = []
    for row in df.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
    yield []


def subscribe_query(graph: Any, text: str, stream: DataFrame, table: str, schema: T.StructType, sink: Callable[[DataFrame, int], None], checkpoint: str, state_path: str, **params: Any):
    """A continuous Cypher query over one label: MATCH (n:Label) [WHERE ...] RETURN ... without aggregation.

    The label's table is `table` of the log, its key the records' key (as the table's key column).
    Frames are those of `subscribe`, with the columns that the query returns.
    """
    parts = parser.parse(text).parts
    clauses = parts[0].clauses
    fits = len(parts) == 1 and len(clauses) == 2 and isinstance(clauses[0], A.Match) and not clauses[0].optional and isinstance(clauses[1], A.Return)
    fits = fits and len(clauses[0].parts) == 1 and len(clauses[0].parts[0].items) == 1
    body = clauses[1].body if fits else None
    if not fits or body.distinct or body.star or body.order or body.skip is not None or body.limit is not None or any(aggregated(i.expr) for i in body.items):
        raise UnsupportedFault("a subscription is one MATCH of one node, a filter and a projection")
    node = clauses[0].parts[0].items[0]
    (mapping,) = [m for m in graph.nodes if m.table == table]
    name = node.var or " subject"
    key = A.Item(A.Func("id", (A.Var(name),)), "_subject")
    named = A.Match((A.Part(None, (A.NodePat(name, node.labels, node.props),)),), clauses[0].where, False)
    query = A.Query((A.Single((named, A.Return(A.Projection((*body.items, key), False, False, (), None, None)))),), ())

    def answer(rows: DataFrame) -> DataFrame:
        """The query's rows over some rows of the table."""
        g = type(graph)(graph.spark, graph.mapping, {**graph.tables, table: rows}, graph.policy)
        g.functions = graph.functions
        return Planner(g, params).run(query)

    columns = [i.name for i in body.items]

    def frame(df: DataFrame, number: int) -> None:
        rows = df.where("NOT deleted").select(F.col("key").cast(schema[mapping.key[0]].dataType).alias(mapping.key[0]), *(c for c in schema.fieldNames() if c != mapping.key[0]))
        found = answer(rows).withColumn("_subject", F.col("_subject").cast("string"))
        out = df.select("key", "version").join(found, F.col("key") == F.col("_subject"), "left")
        sink(out.select("key", "version", F.col("_subject").isNull().alias("deleted"), *(F.col(f"`{c}`") for c in columns)), number)

    return subscribe(stream, table, schema, "true", schema.fieldNames(), frame, checkpoint, state_path)
