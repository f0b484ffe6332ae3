"""Parsing, scopes, patterns, policies and types on small inline graphs."""

from __future__ import annotations

import pytest

from loomgraph import queries
from loomgraph.demo import TABLES
from loomgraph.errors import ArgumentFault, PolicyFault, SemanticFault, SyntaxFault, TypeFault
from loomgraph.graph import Graph
from loomgraph.plans.parser import parse
from loomgraph.policy import Policy
from loomgraph.sources.mapping import from_dict, from_json, from_toml


#: A tram network: rides have minutes, and one stop has no ride at all.
STOPS = {i: (f"stop{i}", (i * 37) % 11) for i in range(8)}
RIDES = [(0, 1, 4), (1, 2, 7), (2, 3, 1), (3, 0, 9), (1, 4, 3), (4, 2, 2), (4, 5, 8), (5, 5, 6), (2, 1, 5)]
PATHS = [(0, 5), (6, 2)]


@pytest.fixture(scope="module")
def tram(spark):
    stops = spark.createDataFrame([(i, n, z) for i, (n, z) in STOPS.items()], "id long, title string, zone long")
    rides = spark.createDataFrame([(i, *r) for i, r in enumerate(RIDES)], "ride long, f long, t long, m long")
    walks = spark.createDataFrame(PATHS, "f long, t long")
    doc = {
        "nodes": [{"label": "Stop", "table": "stops", "key": "id", "properties": {"id": "id", "title": "title", "zone": "zone"}}],
        "edges": [
            {"type": "RIDE", "table": "rides", "source": "Stop", "target": "Stop", "source_key": "f", "target_key": "t", "id": "ride", "properties": {"minutes": "m"}, "enforced": True},
            {"type": "FOOT", "table": "walks", "source": "Stop", "target": "Stop", "source_key": "f", "target_key": "t"},
        ],
    }
    return Graph(spark, from_dict(doc), {"stops": stops, "rides": rides, "walks": walks})


def ways(direction="out", foot=False):
    """(relationship, from, to) of every step; a loop is one step even without a direction."""
    edges = [(("RIDE", i), f, t) for i, (f, t, _) in enumerate(RIDES)] + [(("FOOT", i), f, t) for i, (f, t) in enumerate(PATHS)] * foot
    back = [(e, t, f) for e, f, t in edges]
    return {"out": edges, "in": back, "both": edges + [(e, f, t) for e, f, t in back if f != t]}[direction]


def walks(low, high, direction="out", mode="TRAIL", foot=False):
    """Every walk as (nodes, relationships), by enumeration."""
    steps, out, grown = ways(direction, foot), [], [((s,), ()) for s in STOPS]
    for length in range(high + 1):
        if length >= low:
            out += grown
        after = []
        for nodes, rels in grown:
            if mode == "SIMPLE" and len(nodes) > 1 and nodes[0] == nodes[-1]:
                continue
            for e, f, t in steps:
                if f != nodes[-1] or (mode != "WALK" and e in rels):
                    continue
                if (mode == "ACYCLIC" and t in nodes) or (mode == "SIMPLE" and t in nodes[1:]):
                    continue
                after.append(((*nodes, t), (*rels, e)))
        grown = after
    return out


def asked(graph, text, **params):
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in graph.cypher(text, **params).collect()), key=repr)


@pytest.mark.parametrize("arrow,direction", [("-[r:RIDE]->", "out"), ("<-[r:RIDE]-", "in"), ("-[r:RIDE]-", "both")])
def test_single_hops(tram, arrow, direction):
    got = asked(tram, f"MATCH (a:Stop){arrow}(b) RETURN a.id, b.id, r.minutes")
    assert got == sorted(((f, t, RIDES[e[1]][2]) for e, f, t in ways(direction)), key=repr)


@pytest.mark.parametrize("arrow,direction", [("-[:RIDE]->", "out"), ("-[:RIDE]-", "both")])
def test_two_hops_never_repeat_a_relationship(tram, arrow, direction):
    got = asked(tram, f"MATCH (a:Stop){arrow}(b){arrow}(c) RETURN a.id, b.id, c.id")
    assert got == sorted((n for n, _ in walks(2, 2, direction)), key=repr)


@pytest.mark.parametrize("span,low,high", [("*2", 2, 2), ("*1..3", 1, 3), ("*0..2", 0, 2), ("*", 1, 12), ("*2..", 2, 12)])
@pytest.mark.parametrize("arrow,direction", [("-[rs:RIDE{}]->", "out"), ("<-[rs:RIDE{}]-", "in")])
def test_walks_carry_their_elements(tram, span, low, high, arrow, direction):
    got = asked(tram, f"MATCH p = (a:Stop){arrow.format(span)}(b) RETURN [n IN nodes(p) | n.title], [r IN relationships(p) | r.minutes], length(p)")
    want = [(tuple(STOPS[x][0] for x in n), tuple(RIDES[e[1]][2] for e in r), len(r)) for n, r in walks(low, high, direction)]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("mode", ["TRAIL", "WALK", "SIMPLE", "ACYCLIC"])
def test_modes(tram, mode):
    got = asked(tram, f"MATCH (a:Stop)-[rs:RIDE|FOOT* {mode} 1..4]->(b) RETURN a.id, b.id, size(rs)")
    assert got == sorted(((n[0], n[-1], len(r)) for n, r in walks(1, 4, "out", mode, True)), key=repr)


def test_unbounded_walks_are_refused(tram):
    with pytest.raises(ArgumentFault):
        tram.cypher("MATCH (a:Stop)-[:RIDE* WALK]->(b) RETURN b")


@pytest.mark.parametrize("span,low,high", [("*", 1, 12), ("*0..2", 0, 2), ("*2..4", 2, 4)])
@pytest.mark.parametrize("arrow,direction", [("-[:RIDE{}]->", "out"), ("-[:RIDE{}]-", "both")])
def test_shortest_paths(tram, span, low, high, arrow, direction):
    least = {}
    for n, r in walks(low, min(high, 9), direction):
        if low != 1 or n[0] != n[-1]:
            least[n[0], n[-1]] = min(len(r), least.get((n[0], n[-1]), 99))
    got = asked(tram, f"MATCH p = shortestPath((a:Stop){arrow.format(span)}(b:Stop)) RETURN a.id, b.id, length(p), size(nodes(p))")
    assert got == sorted(((a, b, n, n + 1) for (a, b), n in least.items()), key=repr)


def test_all_shortest_paths_and_their_conditions(tram):
    every = [(n, r) for n, r in walks(1, 9, "both") if n[0] != n[-1]]
    least = {}
    for n, r in every:
        least[n[0], n[-1]] = min(len(r), least.get((n[0], n[-1]), 99))
    want = [n for n, r in every if len(r) == least[n[0], n[-1]] and n[0] == 0]
    assert asked(tram, "MATCH p = allShortestPaths((a:Stop)-[:RIDE*]-(b:Stop)) WHERE a.id = 0 RETURN [n IN nodes(p) | n.id]") == sorted(((n,) for n in want), key=repr)
    assert asked(tram, "MATCH (a:Stop)-[rs:RIDE* ALL SHORTEST]-(b) WHERE a.id = 0 RETURN b.id, size(rs)") == sorted(((n[-1], len(n) - 1) for n in want), key=repr)
    assert asked(tram, "MATCH (b:Stop {id: 3}), (a:Stop {id: 0}) MATCH p = shortestPath((a)-[:RIDE*]->(b)) RETURN length(p)") == [(3,)]
    assert asked(tram, "MATCH p = shortestPath((a:Stop)-[:RIDE* {minutes: 9}]->(b)) RETURN a.id, b.id") == [(3, 0)]


def test_paths_of_any_length_are_found(spark):
    n = 103
    nodes, links = spark.range(n), spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b")
    doc = {"nodes": [{"label": "N", "table": "n", "key": "id", "properties": {"id": "id"}}], "edges": [{"type": "L", "table": "l", "source": "N", "target": "N", "source_key": "a", "target_key": "b", "enforced": True}]}
    g = Graph(spark, from_dict(doc), {"n": nodes, "l": links})
    assert asked(g, f"MATCH p = shortestPath((a:N {{id: 0}})-[:L*]->(b:N {{id: {n - 1}}})) RETURN length(p)") == [(n - 1,)]
    # the search ends when the wanted end is met, far before the chain does
    assert asked(g, "MATCH p = shortestPath((a:N {id: 0})-[:L*3..]->(b:N {id: 4})) RETURN length(p)") == [(4,)]


def test_ends_of_relationships_are_nodes(tram):
    got = asked(tram, "MATCH (a)-[r:RIDE]->(b) WHERE r.minutes > 5 RETURN startNode(r).title, endNode(r).zone, startNode(r) = a, id(endNode(r))")
    assert got == sorted(((STOPS[f][0], STOPS[t][1], True, t) for f, t, m in RIDES if m > 5), key=repr)
    assert asked(tram, "MATCH p = (:Stop {id: 0})-[:RIDE]->() WITH nodes(p)[1] AS m MATCH (m)-[:RIDE]->(c) RETURN c.title") == [("stop2",), ("stop4",)]


def test_subqueries_read_outer_values(tram):
    out = {s: [t for f, t, _ in RIDES if f == s] for s in STOPS}
    got = asked(tram, "UNWIND [1, 3] AS x MATCH (a:Stop) RETURN x, a.id, COUNT { (a)-[:RIDE]->(b) WHERE b.id >= x } AS n, list_sort([(a)-[:RIDE]->(b) WHERE b.id > x | b.id * x]) AS l")
    assert got == sorted(((x, s, sum(t >= x for t in out[s]), tuple(sorted(t * x for t in out[s] if t > x))) for x in (1, 3) for s in STOPS), key=repr)
    got = asked(tram, "UNWIND [1, 5] AS x MATCH (a:Stop) OPTIONAL MATCH (a)-[:RIDE]->(b {zone: x}) RETURN x, a.id, b.id")
    want = [(x, s, t) for x in (1, 5) for s in STOPS for t in ([t for t in out[s] if STOPS[t][1] == x] or [None])]
    assert got == sorted(want, key=repr)
    got = asked(tram, "MATCH (a:Stop) OPTIONAL MATCH (a)-[:RIDE]->(b) WHERE EXISTS { (b)-[:RIDE]->(c) WHERE c.zone < a.zone } RETURN a.id, b.id")
    want = [(s, t) for s in STOPS for t in ([t for t in out[s] if any(STOPS[c][1] < STOPS[s][1] for c in out[t])] or [None])]
    assert got == sorted(want, key=repr)
    assert asked(tram, "UNWIND [1, 2] AS x RETURN x, EXISTS { MATCH (a:Stop) WHERE a.zone > x * 5 } AS e") == [(1, any(z > 5 for _, z in STOPS.values())), (2, any(z > 10 for _, z in STOPS.values()))]


def test_lookups_and_missing_values(tram):
    rides = {f for f, _, _ in RIDES}
    assert asked(tram, "MATCH (a) WHERE NOT (a)-[:RIDE]->() RETURN a.id") == [(s,) for s in STOPS if s not in rides]
    assert asked(tram, "MATCH (a) OPTIONAL MATCH (a)-[w:FOOT]->(b) RETURN a.id, coalesce(b.title, '?')") == sorted(((s, next((STOPS[t][0] for f, t in PATHS if f == s), "?")) for s in STOPS), key=repr)
    assert asked(tram, "UNWIND ['stop1', 'stop1'] AS x MATCH (n:Stop {title: x}) RETURN n.id") == [(1,), (1,)]
    assert asked(tram, "MATCH (n:Stop) RETURN DISTINCT n.colour") == [(None,)]
    assert asked(tram, "UNWIND $list AS x RETURN x", list=None) == [] and asked(tram, "WITH $s AS s UNWIND s AS x RETURN x", s="one") == [("one",)]
    assert asked(tram, "RETURN $s =~ 'a' AS a, regexp_full_match($s, 'a') AS b", s="a\n") == [(False, False)]


def test_operators_and_named_arguments(tram):
    assert asked(tram, "RETURN 6 | 1, [x IN [1, 2] WHERE (x | 1) > 1 | x * 2], substring(length := 2, start := 1, s := 'hello'), 12 & 10, 1 << 4, 5!") == [(7, (4,), "el", 8, 16, 120)]
    with pytest.raises(ArgumentFault):
        tram.cypher("RETURN substring(size := 2, start := 1, s := 'hello')")
    assert asked(tram, "RETURN toString(duration('PT2.5H')), toString(duration('P1.5D')), toString(duration('P0.5Y'))") == [("PT2H30M", "P1DT12H", "P6M")]
    doc = '{"a":{"b":1},"c":"x","d":null,"e":2.5}'
    assert asked(tram, "RETURN json.value($d, '$.a'), json.value($d, '$.a.b'), json.value($d, '$.c'), json.value($d, '$.d'), json.value($d, '$.e'), json.value($d, '$.zz')", d=doc) == [(None, "1", "x", None, "2.5", None)]
    assert asked(tram, "RETURN gcd(12, 18), gcd(0, 5), gcd(-4, 6), lcm(4, 6), round(lgamma(10.5), 8), round(gamma(0.5), 9), gamma(5), round(gamma(-1.5), 9)") == [(6, 5, 2, 12, 13.94062522, 1.772453851, 24.0, 2.363271801)]


def test_aggregates_of_whole_groups(tram):
    zones = sorted(z for _, z in STOPS.values())
    got = asked(tram, "MATCH (s:Stop) RETURN percentileDisc(s.zone, 0.5), percentileDisc(s.zone, 0.0), percentileDisc(s.zone, 1.0), avg(DISTINCT s.zone), count_if(s.zone > 4)")
    assert got == [(zones[3], zones[0], zones[-1], sum(set(zones)) / len(set(zones)), sum(z > 4 for z in zones))]


@pytest.mark.parametrize("text,fault", [
    ("MATCH (a RETURN a", SyntaxFault), ("RETURN", SyntaxFault), ("MATCH (a)", SemanticFault), ("RETURN x", SemanticFault),
    ("MATCH (a) WITH a.k RETURN 1", SyntaxFault), ("RETURN 1 AS a UNION RETURN 2 AS b", SemanticFault), ("MATCH (a {k: 1}) RETURN nope(a.k)", SemanticFault),
    ("MATCH (a) RETURN a.k LIMIT -1", ArgumentFault), ("RETURN $p", ArgumentFault), ("RETURN 1 AND true", TypeFault), ("MATCH (a $m) RETURN a", SyntaxFault),
    ("RETURN count(count(*))", SemanticFault), ("CREATE (a:P)", SemanticFault), ("RETURN 1 AS a, 2 AS a", SemanticFault), ("RETURN " + "(" * 400 + "1" + ")" * 400, SyntaxFault),
])
def test_faults(tram, text, fault):
    with pytest.raises(fault):
        tram.cypher(text).collect()


def test_parser_keeps_comments_and_names():
    q = parse("MATCH (`a b`:P) // note\n WHERE `a b`.x = 0x1F /* c */ RETURN `a b`.x AS `y z`;")
    assert q.parts[0].clauses[-1].body.items[0].name == "y z"


def test_mapping_documents_are_strict():
    doc = '{"nodes": [{"label": "P", "table": "p", "key": "id", "properties": {}, "colour": 1}]}'
    with pytest.raises(SemanticFault):
        from_json(doc)
    assert from_toml('[[nodes]]\nlabel = "P"\ntable = "p"\nkey = ["a", "b"]\nproperties = {}').nodes[0].key == ("a", "b")


def test_policy_filters_masks_and_denies(spark, tram):
    def decide(action, resource):
        if action == "GetRowFilters":
            return ["zone < 6"] if resource["table"] == "stops" else None
        if action == "GetColumnMasks":
            return {"zone": "CAST(NULL AS BIGINT)"} if resource["table"] == "stops" else None
        return resource.get("table") != "walks"

    g = Graph(spark, tram.mapping, tram.tables, Policy(decide))
    assert asked(g, "MATCH (n:Stop) RETURN n.id, n.zone") == [(s, None) for s, (_, z) in STOPS.items() if z < 6]
    with pytest.raises(PolicyFault):
        g.cypher("MATCH ()-[x:FOOT]->() RETURN x").collect()
    with pytest.raises(PolicyFault):
        Graph(spark, tram.mapping, tram.tables, Policy(lambda a, r: 1 / 0)).cypher("MATCH (n) RETURN n")


def test_permission_scopes(spark, tram):
    granted = spark.createDataFrame([("stop", "view", "1", "user", "", "ann"), ("stop", "view", "4", "user", "", "ann"), ("stop", "view", "2", "user", "", "bob")],
                                    "resource_type string, resource_rel string, resource_id string, subject_type string, subject_rel string, subject_id string")
    allow = lambda action, resource: True if action in ("ExecuteQuery", "SelectFromColumns") else None
    policy = Policy(allow, granted, {"stops": {"resource_type": "stop", "relation": "view", "column": "id"}}, ("user", "ann"))
    assert asked(Graph(spark, tram.mapping, tram.tables, policy), "MATCH (n:Stop) RETURN n.id") == [(1,), (4,)]


def test_custom_functions_and_procedures(spark, tram):
    tram.register("twice", lambda x: x * 2).register_procedure("nums", lambda n: spark.range(n).withColumnRenamed("id", "i"))
    assert [r[0] for r in tram.cypher("CALL nums(3) YIELD i RETURN sum(twice(i))").collect()] == [6]


def test_pushdown_reaches_the_scan(spark, data):
    plan = queries.queries()["scan_filter"](spark, data)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(p_size)" in plan and "p_retailprice" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_foreign_key_hops_need_one_join(spark, data):
    plan = queries.queries()["segment_totals"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_equal_their_sql(spark, data, name):
    import math

    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    norm = lambda v: ("nan" if math.isnan(v) else float(f"{v:.11g}")) if isinstance(v, float) else v
    df = queries.queries()[name](spark, data)
    want = con.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted([tuple(norm(r[c]) for c in cols) for r in df.collect()], key=repr) == sorted([tuple(norm(r[i]) for i in at) for r in want.fetchall()], key=repr)


@pytest.mark.parametrize("by,cut", [([], False), (["k"], False), (["k"], True)])
def test_asof_plans_agree_with_a_search(spark, by, cut, monkeypatch):
    import random

    from loomgraph.operators import asof as module

    monkeypatch.setattr(module, "BUCKETS", 5)
    rng = random.Random(3)
    left = [(i, rng.choice("ab"), rng.choice([None, *range(40)])) for i in range(60)]
    right = [(i, rng.choice("abc"), rng.choice([None, *range(40)])) for i in range(50)]
    l = spark.createDataFrame(left, "i long, lk string, lt long").repartition(3)
    r = spark.createDataFrame(right, "_b long, rk string, rt long").repartition(3)
    got = module.asof(l, r, "lt", "rt", ["lk"] if by else [], ["rk"] if by else [], "_b", cut)
    want = {}
    for i, k, t in left:
        fits = [(u, -j) for j, m, u in right if t is not None and u is not None and u <= t and (not by or k == m)]
        if fits:
            want[i] = -max(fits)[1]
    assert {x.i: x._b for x in got.collect()} == want
