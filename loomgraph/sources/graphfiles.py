"""Graphs in files: GraphML (XML) and GraphSON (one vertex a line, with its edges out), read and written by Spark.

Both are read into two tables, nodes (id, label, properties) and edges (id, type, source, target,
properties), with properties as a map of texts. `mapped` makes a graph of them: one table a label or
type, one column a property, typed by the file's key declarations or by a sample of the values.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SemanticFault
from ..graph import Graph
from .mapping import EdgeMapping, Mapping, NodeMapping

NODES = "id string, label string, properties map<string,string>"
EDGES = "id string, `type` string, source string, target string, properties map<string,string>"
#: GraphML's types as Spark's.
TYPES = {"int": "int", "long": "bigint", "float": "float", "double": "double", "boolean": "boolean", "string": "string"}


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict[tuple[str, str], str]]:
    """Nodes, edges and the declared type of each (node or edge, property); labels are the keys labelV and labelE."""
    read = lambda tag, schema: spark.read.schema(schema).options(rowTag=tag, valueTag="value").format("xml").load(path)
    keys = read("key", "_id string, `_for` string, `_attr.name` string, `_attr.type` string").collect()  # one row a property
    names = {r["_id"]: r["_attr.name"] or r["_id"] for r in keys}
    types = {(r["_for"] or "node", names[r["_id"]]): TYPES.get(r["_attr.type"], "string") for r in keys}
    data = "data array<struct<`_key`: string, value: string>>"
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.create_map().cast("map<string,string>")
    entries = F.transform(F.coalesce("data", F.array().cast("array<struct<_key:string,value:string>>")), lambda d: F.struct(F.coalesce(known[d["_key"]], d["_key"]), d["value"]))
    whole = F.map_from_entries(entries)
    rest = F.map_filter(whole, lambda k, v: ~k.isin("labelV", "labelE"))
    nodes = read("node", f"_id string, {data}").select(F.col("_id").alias("id"), F.coalesce(whole["labelV"], F.lit("vertex")).alias("label"), rest.alias("properties"))
    edges = read("edge", f"_id string, _source string, _target string, {data}")
    ident = F.coalesce("_id", F.concat_ws("|", "_source", "_target", F.to_json(whole)))
    return nodes, edges.select(ident.alias("id"), F.coalesce(whole["labelE"], F.lit("edge")).alias("type"), F.col("_source").alias("source"), F.col("_target").alias("target"), rest.alias("properties")), types


def graphson(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of GraphSON lines, typed values ({"@type": .., "@value": ..}) or plain ones."""

    def plain(v: Column) -> Column:
        return F.coalesce(F.try_variant_get(v, "$['@value']", "string"), F.try_variant_get(v, "$", "string"))

    vertex = "id variant, label string, outE map<string,array<struct<id:variant,inV:variant,properties:map<string,variant>>>>, properties map<string,array<struct<value:variant>>>"
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", vertex, {"mode": "FAILFAST"}).alias("v")).select("v.*")
    empty = F.create_map().cast("map<string,string>")
    nodes = lines.select(plain(F.col("id")).alias("id"), "label", F.coalesce(F.transform_values("properties", lambda _, v: plain(F.get(v, F.lit(0))["value"])), empty).alias("properties"))
    out = lines.select(plain(F.col("id")).alias("source"), F.explode("outE").alias("type", "es")).select("source", "type", F.explode("es").alias("e"))
    edges = out.select(plain(F.col("e.id")).alias("id"), "type", "source", plain(F.col("e.inV")).alias("target"), F.coalesce(F.transform_values("e.properties", lambda _, v: plain(v)), empty).alias("properties"))
    return nodes, edges


def write_graphson(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """GraphSON lines of nodes (id, label, properties) and edges (id, type, source, target, properties)."""
    listed = edges.groupBy("source", "type").agg(F.collect_list(F.struct("id", F.col("target").alias("inV"), "properties")).alias("es"))
    out = listed.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("type", "es"))).alias("outE"))
    props = F.transform_values("properties", lambda _, v: F.array(F.struct(v.alias("value"))))
    rows = nodes.join(out, nodes["id"] == out["source"], "left").select("id", "label", "outE", props.alias("properties"))
    rows.select(F.to_json(F.struct("id", "label", "outE", "properties")).alias("value")).write.text(path)


def mapped(nodes: DataFrame, edges: DataFrame, types: dict[tuple[str, str], str] | None = None) -> Graph:
    """A graph over imported tables: labels, types and their property names are asked once, values stay where they are."""
    spark, types = nodes.sparkSession, types or {}
    tables: dict[str, Any] = {}

    def split(df: DataFrame, by: str, kind: str, fixed: list[str]) -> dict[str, list[str]]:
        names = df.select(by, F.explode_outer(F.map_keys("properties")).alias("p")).groupBy(by).agg(F.collect_set("p").alias("ps"))
        found = {r[by]: sorted(r["ps"]) for r in names.collect()}  # one row a label or type
        for name, props in found.items():
            clash = set(props) & {f"_{f}" for f in fixed}
            if clash:
                raise SemanticFault(f"{sorted(clash)} are no property names")
            part = df.where(F.col(by) == name)
            columns = [F.col("properties")[p].try_cast(types.get((kind, p), "string")).alias(p) for p in props]
            tables[f"{kind}:{name}"] = part.select(*(F.col(f).alias(f"_{f}") for f in fixed), *columns)
        return found

    labels = split(nodes, "label", "node", ["id"])
    kinds = split(edges, "type", "edge", ["id", "source", "target"])
    maps = tuple(NodeMapping(x, f"node:{x}", ("_id",), {"id": "_id", **{p: p for p in ps}}) for x, ps in sorted(labels.items()))
    # the ends' labels decide which tables a relationship joins
    of = nodes.select(F.col("id").alias("k"), F.col("label").alias("l"))
    ends = edges.join(of.withColumnsRenamed({"k": "source", "l": "a"}), "source").join(of.withColumnsRenamed({"k": "target", "l": "b"}), "target")
    links = []
    for t, a, b in sorted(tuple(r) for r in ends.select("type", "a", "b").distinct().collect()):  # one row a type and pair of labels
        name = f"edge:{t}:{a}:{b}"
        tables[name] = tables[f"edge:{t}"].join(of.where(F.col("l") == a), F.col("_source") == F.col("k"), "left_semi").join(of.where(F.col("l") == b), F.col("_target") == F.col("k"), "left_semi")
        links.append(EdgeMapping(t, name, a, b, ("_source",), ("_target",), {p: p for p in kinds[t]}, ("_id",)))
    return Graph(spark, Mapping(maps, tuple(links)), tables)
