"""Change records and subscriptions."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

from loomgraph.errors import PolicyFault, SemanticFault, UnsupportedFault
from loomgraph.streaming import changes as C

LOG = [
    (0, 0, "p", "a", 1, '{"x":1}'), (0, 1, "p", "a", 3, '{"x":3}'), (0, 2, "p", "a", 2, '{"x":2}'),
    (1, 0, "p", "b", 1, '{"x":9}'), (1, 1, "p", "b", 1, '{"x":9}'), (1, 2, "p", "b", 2, None),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, C.SCHEMA)


def test_latest_and_tombstones(spark):
    got = {(r.key, r.version, r.data) for r in C.latest(frame(spark, LOG)).collect()}
    assert got == {("a", 3, '{"x":3}')}
    with pytest.raises(C.ChangeConflict):
        C.merge(frame(spark, LOG), frame(spark, [(0, 3, "p", "a", 3, '{"x":4}')]))


def test_snapshot_and_gaps(spark):
    log = frame(spark, LOG)
    assert {r.key: r.data for r in C.snapshot(log, {0: 0, 1: 0}, {0: 1, 1: 1}).collect()} == {"a": '{"x":1}', "b": '{"x":9}'}
    base = C.snapshot(log, {0: 0, 1: 0}, {0: 1, 1: 1})
    later = C.snapshot(log, {0: 1, 1: 1}, {0: 3, 1: 3}, base)
    assert {r.key: r.version for r in later.collect()} == {"a": 3, "b": 2}
    with pytest.raises(SemanticFault):
        C.snapshot(log.where("offset <> 1"), {0: 0, 1: 0}, {0: 3, 1: 3})


def test_subscription_retracts(spark, tmp_path):
    src, frames = str(tmp_path / "in"), []
    schema = T.StructType([T.StructField("x", T.LongType())])
    for batch in (LOG[:1] + LOG[3:4], LOG[1:2] + LOG[5:6]):
        frame(spark, batch).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(C.SCHEMA).parquet(src)
        q = C.subscribe(stream, "p", schema, "x < 3 OR x = 9", ["x"], lambda df, n: frames.append(sorted((r.key, r.deleted, r.x) for r in df.collect())), str(tmp_path / "cp"), str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(90)
    assert frames == [[("a", False, 1), ("b", False, 9)], [("a", True, None), ("b", True, None)]]


def test_event_time(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    n = events.count()
    assert C.windowed(events, "1 day").groupBy().sum("n").first()[0] == n
    assert C.sessions(events, "30 minutes").groupBy().sum("n").first()[0] == n


NODE = T.StructType([T.StructField("x", T.LongType()), T.StructField("name", T.StringType())])
LINK = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
RULES = {"p": C.Rule(NODE, ("x",), "see p", "write p"), "l": C.Rule(LINK, ("a", "b"), "see l", "write l", ("p", "a", "p", "b"))}


def test_payloads_and_permissions_are_checked_before_anything(spark):
    good = frame(spark, [(0, 0, "p", "a", 1, '{"x":1,"name":"n"}'), (0, 1, "l", "e", 1, '{"a":"a","b":"z"}'), (0, 2, "p", "a", 2, None)])
    assert C.validated(good, RULES).count() == 3
    for table, data in (("q", "{}"), ("p", '{"name":"no x"}'), ("p", '{"x":'), ("p", '{"x":"word"}')):
        with pytest.raises(SemanticFault):
            C.validated(good.unionByName(frame(spark, [(0, 3, table, "k", 1, data)])), RULES)
    assert C.authorized(good, RULES, lambda p: True).count() == 3
    for may in (lambda p: p != "write l", lambda p: 1 / 0, lambda p: "yes"):
        with pytest.raises(PolicyFault):
            C.authorized(good, RULES, may)
    assert C.authorized(good.where("table = 'p'"), RULES, lambda p: p == "see p", write=False).count() == 2


def test_edges_need_both_ends(spark):
    rows = [(0, 0, "p", "a", 1, '{"x":1}'), (0, 1, "p", "b", 1, '{"x":2}'), (0, 2, "p", "c", 2, None), (0, 3, "l", "e", 1, '{"a":"a","b":"b"}'), (0, 4, "l", "f", 1, '{"a":"a","b":"c"}')]
    assert sorted(r.key for r in C.visible(C.latest(frame(spark, rows), True), RULES).collect()) == ["a", "b", "e"]


def test_limits_and_frames(spark):
    log = frame(spark, LOG)
    whole = ({0: 0, 1: 0}, {0: 3, 1: 3})
    assert C.limited(log, *whole).count() == 2
    for limits in (C.Limits(records=5), C.Limits(entities=1), C.Limits(seconds=0)):
        with pytest.raises(SemanticFault):
            C.limited(log, *whole, limits)
    assert [len(f) for f in C.frames(spark.range(10).repartition(3), 4)] == [4, 4, 2, 0]


def test_a_cypher_query_as_a_subscription(spark, tmp_path):
    from loomgraph.graph import Graph
    from loomgraph.sources.mapping import from_dict

    schema = T.StructType([T.StructField("id", T.StringType()), *NODE.fields])
    doc = {"nodes": [{"label": "Thing", "table": "p", "key": "id", "properties": {"id": "id", "x": "x", "name": "name"}}]}
    g = Graph(spark, from_dict(doc), {"p": spark.createDataFrame([], schema)})
    src, got = str(tmp_path / "in"), []
    text = "MATCH (t:Thing) WHERE t.x < $top RETURN t.x * 10 AS y, toUpper(t.name) AS name"
    for batch in ([(0, 0, "p", "a", 1, '{"x":1,"name":"one"}'), (0, 1, "p", "b", 1, '{"x":9,"name":"nine"}')], [(0, 2, "p", "a", 2, '{"x":7,"name":"one"}'), (0, 3, "p", "b", 2, '{"x":2,"name":"two"}')]):
        frame(spark, batch).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(C.SCHEMA).parquet(src)
        q = C.subscribe_query(g, text, stream, "p", schema, lambda df, n: got.append(sorted((r.key, r.deleted, r.y, r.name) for r in df.collect())), str(tmp_path / "cp"), str(tmp_path / "state"), top=5).trigger(availableNow=True).start()
        q.awaitTermination(90)
    assert got == [[("a", False, 10, "ONE"), ("b", True, None, None)], [("a", True, None, None), ("b", False, 20, "TWO")]]
    for bad in ("MATCH (t:Thing) RETURN count(*) AS n", "MATCH (t:Thing)-->(u) RETURN u", "MATCH (t:Thing) RETURN t.x ORDER BY t.x"):
        with pytest.raises(UnsupportedFault):
            C.subscribe_query(g, bad, stream, "p", schema, print, "c", "s")
