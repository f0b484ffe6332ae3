"""Catalog revisions, collections, declared functions, plans, statistics and readers."""

from __future__ import annotations

import pyarrow as pa
import pytest

from loomgraph.catalog import Catalog
from loomgraph.demo import graph
from loomgraph.errors import ConstraintFault, SemanticFault, UnsupportedFault
from loomgraph.graph import Graph
from loomgraph.sources import readers
from loomgraph.sources.mapping import ComputedMapping, EdgeMapping, from_dict

DOC = {
    "nodes": [{"label": "Box", "table": "boxes", "key": "id", "properties": {"id": "id", "size": "size"}},
              {"label": "Item", "table": "boxes", "key": ["id", "at"], "properties": {"at": "at", "what": "what"}, "collection": {"column": "items", "as": "what", "ordinality": "at"}}],
    "edges": [{"type": "HOLDS", "table": "boxes", "source": "Box", "target": "Item", "source_key": "id", "target_key": ["id", "at"], "id": ["id", "at"], "collection": {"column": "items", "as": "what", "ordinality": "at"}}],
}


@pytest.fixture(scope="module")
def boxes():
    return {"boxes": pa.table({"id": [1, 2, 3], "size": [5, 7, 9], "items": [["a", "b"], [], ["c", None]], "doc": ['{"k":[1,2]}', "{}", None]})}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_collections_are_rows(spark, boxes):
    g = Graph(spark, from_dict(DOC), boxes)
    assert rows(g.cypher("MATCH (b:Box)-[:HOLDS]->(i:Item) RETURN b.id, i.at, i.what")) == [(1, 0, "a"), (1, 1, "b"), (3, 0, "c"), (3, 1, None)]
    outer = {"nodes": [{"label": "I", "table": "boxes", "key": "id", "properties": {"id": "id", "w": "w"}, "collection": {"expr": "from_json(get_json_object(doc, '$.k'), 'array<int>')", "as": "w", "outer": True}}]}
    assert rows(Graph(spark, from_dict(outer), boxes).cypher("MATCH (n:I) RETURN n.id, n.w")) == [(1, 1), (1, 2), (2, None), (3, None)]
    with pytest.raises(SemanticFault):
        from_dict({"nodes": [{"label": "I", "table": "b", "key": "id", "properties": {}, "collection": {"as": "w"}}]})


def test_catalog_revisions(spark, boxes):
    c = Catalog(spark, from_dict(DOC), boxes)
    near = EdgeMapping("NEAR", "boxes", "Box", "Box", ("id",), ("size",))
    first = c.snapshot()
    assert c.register(near, 0).revision == 1
    with pytest.raises(ConstraintFault):
        c.register(near, 0)
    one = ComputedMapping("ONE", "Box", "Box", "cypher", {"query": "MATCH (a:Box)-[:NEAR]->(b:Box) RETURN a.id AS source, b.id AS target"})
    c.register(one, 1)
    with pytest.raises(SemanticFault):
        c.remove("NEAR", 2)  # ONE is made from it
    two = ComputedMapping("NEAR2", "Box", "Box", "cypher", {"query": "MATCH (a:Box)-[:LOOP]->(b:Box) RETURN a.id AS source, b.id AS target"})
    loop = ComputedMapping("LOOP", "Box", "Box", "cypher", {"query": "MATCH (a:Box)-[:NEAR2]->(b:Box) RETURN a.id AS source, b.id AS target"})
    c.register(two, 2)
    with pytest.raises(SemanticFault):
        c.register(loop, 3)
    c.remove("ONE", 3)
    assert c.remove("NEAR", 4).revision == 5 and len(first.mapping.edges) == 1
    with pytest.raises(SemanticFault):
        c.remove("NEAR", 5)
    assert c.graph(first).cypher("MATCH (b:Box) RETURN b").count() == 3


def test_declared_functions_and_aggregates(spark, boxes):
    from pyspark.sql import functions as F

    g = Graph(spark, from_dict(DOC), boxes)
    g.declare("area", lambda x, y: x * y, ["int64", "float64"], "int64")
    g.declare("agg.product", lambda x: F.product(x), ["float64"], "int64", aggregate=True)
    assert rows(g.cypher("MATCH (b:Box) RETURN area(b.size, '2')")) == [(10,), (14,), (18,)]
    assert rows(g.cypher("MATCH (b:Box) RETURN b.size > 6 AS big, agg.product(b.size) + 1 AS p")) == [(False, 6), (True, 64)]
    for text in ("MATCH (b:Box) WHERE agg.product(b.size) > 1 RETURN b", "MATCH (b:Box) RETURN agg.nope(b.size)"):
        with pytest.raises(SemanticFault):
            g.cypher(text)
    with pytest.raises(SemanticFault):
        g.declare("product", lambda x: x, ["float64"], "int64", aggregate=True)


def test_plans_arrow_and_statistics(spark, data):
    g = graph(spark, data)
    assert "Scan parquet" in g.cypher("EXPLAIN MATCH (p:Part) WHERE p.size > 40 RETURN p.name").first()["plan"]
    assert "sizeInBytes" in g.cypher("explain cost MATCH (p:Part) RETURN p.name").first()["plan"]
    assert g.arrow("MATCH (r:Region) RETURN r.name AS name ORDER BY name")["name"].to_pylist() == sorted(r.r_name for r in g.table("region").collect())
    got = {(r["name"], r["property"]): (r["rows"], r["distinct"], r["nulls"]) for r in g.statistics(columns=True).where("table IN ('nation', 'region')").collect()}
    assert got["Region", None][0] == 5 and got["Region", "name"] == (5, 5, 0) and got["IN_REGION", None][0] == 25


def test_readers(spark, tmp_path, data):
    spark.range(3).write.csv(str(tmp_path / "c"))
    assert readers.files(spark, "csv", str(tmp_path / "c"), "id long")().count() == 3
    for open_ in (readers.iceberg(spark, "a.b", 3), readers.delta(spark, "/x", 1), readers.kafka(spark, "h:1", "t"), readers.jdbc(spark, "jdbc:none:x", "t", "id", (0, 9), 3)):
        with pytest.raises(UnsupportedFault):
            open_()


def test_catalog_is_saved_and_loaded(spark, boxes, tmp_path):
    c = Catalog(spark, from_dict(DOC), boxes)
    c.register(EdgeMapping("NEAR", "boxes", "Box", "Box", ("id",), ("size",)), 0)
    c.save(str(tmp_path / "catalog"))
    again = Catalog.load(spark, str(tmp_path / "catalog"), boxes)
    assert again.snapshot() == c.snapshot() and rows(again.graph().cypher("MATCH (b:Box)-[:HOLDS]->(i) RETURN i.what")) == [("a",), ("b",), ("c",), (None,)]


def test_functions_are_listed(spark, boxes):
    got = dict(rows(Graph(spark, from_dict(DOC), boxes).register("mine", lambda x: x).cypher("CALL db.functions() YIELD name, kind RETURN name, kind")))
    assert got["substring"] == "function" and got["collect"] == "aggregate" and got["mine"] == "function"


ML = """<?xml version="1.0"?>
<graphml>
  <key id="labelV" for="node" attr.name="labelV" attr.type="string"/>
  <key id="labelE" for="edge" attr.name="labelE" attr.type="string"/>
  <key id="k0" for="node" attr.name="age" attr.type="int"/>
  <key id="k1" for="edge" attr.name="weight" attr.type="double"/>
  <graph id="G" edgedefault="directed">
    <node id="1"><data key="labelV">cat</data><data key="k0">3</data></node>
    <node id="2"><data key="labelV">cat</data><data key="k0">5</data></node>
    <node id="3"><data key="labelV">toy</data></node>
    <edge id="7" source="1" target="2"><data key="labelE">likes</data><data key="k1">0.5</data></edge>
    <edge id="8" source="2" target="3"><data key="labelE">likes</data><data key="k1">0.25</data></edge>
  </graph>
</graphml>
"""


def test_graph_files(spark, tmp_path):
    from loomgraph.sources import graphfiles as G

    (tmp_path / "g.xml").write_text(ML)
    nodes, edges, types = G.graphml(spark, str(tmp_path / "g.xml"))
    g = G.mapped(nodes, edges, types)
    asked = "MATCH (a:cat)-[r:likes]->(b) RETURN a.age AS a, label(b) AS l, r.weight AS w"
    assert rows(g.cypher(asked)) == [(3, "cat", 0.5), (5, "toy", 0.25)]
    G.write_graphson(nodes, edges, str(tmp_path / "out"))
    again = G.mapped(*G.graphson(spark, str(tmp_path / "out")), types)
    assert rows(again.cypher(asked)) == rows(g.cypher(asked))
    typed = '{"id":{"@type":"g:Int32","@value":1},"label":"p","outE":{"knows":[{"id":{"@type":"g:Int32","@value":9},"inV":{"@type":"g:Int32","@value":2},"properties":{"w":{"@type":"g:Double","@value":1.5}}}]},"properties":{"name":[{"id":{"@type":"g:Int64","@value":0},"value":"ann"}]}}\n{"id":{"@type":"g:Int32","@value":2},"label":"p","properties":{"name":[{"value":"bob"}]}}\n'
    (tmp_path / "t.json").write_text(typed)
    got = G.mapped(*G.graphson(spark, str(tmp_path / "t.json")), {("edge", "w"): "double"})
    assert rows(got.cypher("MATCH (a)-[r:knows]->(b) RETURN a.name, r.w, b.name")) == [("ann", 1.5, "bob")]


def test_typed_fixtures(spark):
    from loomgraph.sources import fixtures

    doc = {"t": {"columns": {"id": "int64", "at": "timestamp", "tags": "list:string"}, "rows": [[1, "2020-01-02 03:04:05", ["a"]], {"id": 2}]}}
    df = fixtures.tables(spark, doc)["t"]
    assert [t for _, t in df.dtypes][0] == "bigint" and [(r.id, str(r["at"]), r.tags) for r in df.orderBy("id").collect()] == [(1, "2020-01-02 03:04:05", ["a"]), (2, "None", None)]
    with pytest.raises(SemanticFault):
        fixtures.tables(spark, {"t": {"columns": {"id": "int64"}, "rows": [[1, 2]]}})
