"""The star-schema tables as a graph: used by the entry module, the bench and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .graph import Graph
from .sources.mapping import from_dict

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _node(label: str, table: str, key: str, prefix: str, columns: str, **more) -> dict:
    return {"label": label, "table": table, "key": key, "properties": {c: f"{prefix}{c}" for c in columns.split()}, **more}


MAPPING = {
    "nodes": [
        _node("Region", "region", "r_regionkey", "r_", "regionkey name"),
        _node("Nation", "nation", "n_nationkey", "n_", "nationkey name regionkey"),
        _node("Customer", "customer", "c_custkey", "c_", "custkey name nationkey acctbal mktsegment", extra_labels=["Party"]),
        _node("Supplier", "supplier", "s_suppkey", "s_", "suppkey name nationkey acctbal", extra_labels=["Party"]),
        _node("Part", "part", "p_partkey", "p_", "partkey name brand type size retailprice"),
        _node("Order", "orders", "o_orderkey", "o_", "orderkey custkey orderstatus totalprice orderdate orderpriority"),
        _node("Event", "events", "event_id", "", "event_id ts user_id event_type value props"),
        _node("Document", "documents", "doc_id", "", "doc_id text lang source n_chars"),
        _node("Vector", "embeddings", "vec_id", "", "vec_id embedding label"),
        _node("Page", "pages", "page_id", "", "page_id url"),
        _node("Passage", "benchmark", "item_id", "", "item_id text"),
        _node("BigOrder", "orders", "o_orderkey", "o_", "orderkey custkey totalprice", where="o_totalprice > 350000"),
        _node("Component", "components", "id", "", "id position value", query="SELECT concat(vec_id, ':', position) AS id, position, CAST(value AS DOUBLE) AS value FROM (SELECT vec_id, posexplode(embedding) AS (position, value) FROM {embeddings})"),
        _node("Number", "numbers", "value", "", "value", query="SELECT id AS value FROM range(100)"),
        _node("Rating", "labels", "doc_id", "", "doc_id quality toxic"),
    ],
    "edges": [
        {"type": "IN_REGION", "table": "nation", "source": "Nation", "target": "Region", "source_key": "n_nationkey", "target_key": "n_regionkey", "enforced": True},
        {"type": "FROM_NATION", "table": "customer", "source": "Customer", "target": "Nation", "source_key": "c_custkey", "target_key": "c_nationkey", "enforced": True},
        {"type": "FROM_NATION", "table": "supplier", "source": "Supplier", "target": "Nation", "source_key": "s_suppkey", "target_key": "s_nationkey", "enforced": True},
        {"type": "PLACED", "table": "orders", "source": "Customer", "target": "Order", "source_key": "o_custkey", "target_key": "o_orderkey", "enforced": True},
        {"type": "CONTAINS", "table": "lineitem", "source": "Order", "target": "Part", "source_key": "l_orderkey", "target_key": "l_partkey", "enforced": True,
         "properties": {c: f"l_{c}" for c in "linenumber quantity extendedprice discount tax returnflag linestatus shipdate".split()}},
        {"type": "SUPPLIED_BY", "table": "lineitem", "source": "Order", "target": "Supplier", "source_key": "l_orderkey", "target_key": "l_suppkey", "enforced": True,
         "properties": {"quantity": "l_quantity", "extendedprice": "l_extendedprice"}},
        {"type": "DID", "table": "events", "source": "Customer", "target": "Event", "source_key": "user_id", "target_key": "event_id", "enforced": True},
        {"type": "RATED", "table": "labels", "source": "Document", "target": "Rating", "source_key": "doc_id", "target_key": "doc_id", "enforced": True},
        {"type": "PLACED_BIG", "table": "orders", "source": "Customer", "target": "BigOrder", "source_key": "o_custkey", "target_key": "o_orderkey", "where": "o_totalprice > 350000", "id": "o_orderkey"},
        {"type": "HAS_VALUE", "table": "components", "source": "Vector", "target": "Component", "source_key": "vec_id", "target_key": "id", "id": "id",
         "query": "SELECT vec_id, concat(vec_id, ':', position) AS id FROM (SELECT vec_id, posexplode(embedding) AS (position, value) FROM {embeddings})"},
        {"type": "NEIGHBOUR", "table": "nation", "source": "Nation", "target": "Nation", "source_key": "n_nationkey", "target_key": "next_key", "id": "n_nationkey",
         "query": "SELECT n_nationkey, CAST((n_nationkey * 7 + 3) % 25 AS INT) AS next_key FROM {nation}", "enforced": True},
    ],
    "computed": [
        {"type": "BEFORE", "source": "Event", "target": "Order", "kind": "as_of", "options": {"source_time": "ts", "target_time": "orderdate", "partition": [["user_id", "custkey"]]}},
        {"type": "SIMILAR", "source": "Vector", "target": "Vector", "kind": "top_k", "options": {"vector": ["embedding", "embedding"], "k": 3, "where": "a.vec_id % 20 = 0"}},
        {"type": "MATCHES", "source": "Passage", "target": "Document", "kind": "search", "options": {"text": ["text", "text"], "k": 3}},
        {"type": "SAME_SIZE", "source": "Part", "target": "Part", "kind": "predicate", "options": {"on": "a.size = b.size AND a.brand = b.brand AND a.partkey < b.partkey"}},
        {"type": "BUYS", "source": "Customer", "target": "Part", "kind": "cypher", "options": {
            "query": "MATCH (c:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part) WHERE l.quantity > 48 RETURN DISTINCT c.custkey AS source, p.partkey AS target"}},
    ],
}


def graph(spark: SparkSession, sf_dir: str, **more) -> Graph:
    """The graph over the parquet tables below `sf_dir`; tables are opened when a query needs them."""
    tables = {t: (lambda t=t: spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in TABLES}
    return Graph(spark, from_dict(MAPPING), tables, **more)
