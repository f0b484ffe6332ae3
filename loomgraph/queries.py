"""Named queries over the star-schema graph, each with the same question in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .demo import graph

#: name: (Cypher or a function of session and folder, parameters, SQL or None)
QUERIES: dict[str, tuple[str | Callable[[SparkSession, str], DataFrame], dict[str, Any], str | None]] = {}


def q(name: str, cypher: str | Callable[[SparkSession, str], DataFrame], sql: str | None, **params: Any) -> None:
    QUERIES[name] = (cypher, params, sql)


# --- matching -------------------------------------------------------------------------------
q("segment_totals",
  "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > $min RETURN c.mktsegment AS segment, "
  "count(*) AS n, round(sum(o.totalprice), 2) AS total ORDER BY segment",
  "SELECT c_mktsegment AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN "
  "orders ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY 1", min=100000)
q("scan_filter", "MATCH (p:Part) WHERE p.size >= 40 AND p.brand STARTS WITH 'Brand#1' RETURN p.partkey AS k, p.name AS name, p.size AS size",
  "SELECT p_partkey AS k, p_name AS name, p_size AS size FROM part WHERE p_size >= 40 AND p_brand LIKE 'Brand#1%'")
q("label_expression", "MATCH (p:Party) WHERE p.acctbal < 0 RETURN labels(p)[0] AS label, p.name AS name",
  "SELECT 'Customer' AS label, c_name AS name FROM customer WHERE c_acctbal < 0 UNION ALL SELECT "
  "'Supplier', s_name FROM supplier WHERE s_acctbal < 0")
q("label_negation", "MATCH (p:Party&!Supplier) RETURN count(*) AS n", "SELECT count(*) AS n FROM customer")
q("expand_fk", "MATCH (o:Order {orderpriority: '1-URGENT'})<-[:PLACED]-(c) RETURN o.orderkey AS k, c.name AS name, o.totalprice AS price",
  "SELECT o_orderkey AS k, c_name AS name, o_totalprice AS price FROM orders JOIN customer ON o_custkey = "
  "c_custkey WHERE o_orderpriority = '1-URGENT'")
q("expand_table", "MATCH (o:Order)-[l:CONTAINS]->(p:Part) WHERE l.quantity > 49 RETURN o.orderkey AS o, p.partkey AS p, l.linenumber AS line",
  "SELECT l_orderkey AS o, l_partkey AS p, l_linenumber AS line FROM lineitem WHERE l_quantity > 49")
q("expand_in", "MATCH (p:Part)<-[l:CONTAINS]-(o:Order) WHERE p.size = 1 RETURN p.partkey AS p, count(l) AS n",
  "SELECT p_partkey AS p, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size = 1 GROUP BY 1")
q("expand_into", "MATCH (c:Customer)-[:FROM_NATION]->(n:Nation) MATCH (s:Supplier)-[:FROM_NATION]->(n) RETURN n.name AS nation, count(*) AS pairs",
  "SELECT n_name AS nation, count(*) AS pairs FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN "
  "supplier ON s_nationkey = n_nationkey GROUP BY 1")
q("expand_undirected", "MATCH (a:Nation)-[:NEIGHBOUR]-(b:Nation) RETURN a.nationkey AS a, b.nationkey AS b",
  "WITH e AS (SELECT n_nationkey AS a, CAST((n_nationkey * 7 + 3) % 25 AS INT) AS b FROM nation) SELECT a, "
  "b FROM e UNION ALL SELECT b, a FROM e WHERE a <> b")
q("multi_partition_type", "MATCH (p)-[:FROM_NATION]->(n:Nation) RETURN n.name AS nation, label(p) AS label, count(*) AS n",
  "SELECT n_name AS nation, 'Customer' AS label, count(*) AS n FROM customer JOIN nation ON c_nationkey = "
  "n_nationkey GROUP BY 1 UNION ALL SELECT n_name, 'Supplier', count(*) FROM supplier JOIN nation ON "
  "s_nationkey = n_nationkey GROUP BY 1")
q("three_hop", "MATCH (c:Customer)-[:FROM_NATION]->(n)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(c) AS n",
  "SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
q("two_hop_unique", "MATCH (a:Nation)-[r1:NEIGHBOUR]-(b)-[r2:NEIGHBOUR]-(c:Nation) RETURN a.nationkey AS a, count(*) AS n",
  "WITH e AS (SELECT n_nationkey AS id, n_nationkey AS a, CAST((n_nationkey * 7 + 3) % 25 AS INT) AS b FROM "
  "nation), u AS (SELECT id, a, b FROM e UNION ALL SELECT id, b, a FROM e WHERE a <> b) SELECT x.a AS a, "
  "count(*) AS n FROM u x JOIN u y ON x.b = y.a AND x.id <> y.id GROUP BY 1")
q("siblings", "MATCH (a:Order)<-[:PLACED]-(c)-[:PLACED]->(b:Order) RETURN a.orderkey AS k, count(*) AS n, max(b.totalprice) AS top",
  "SELECT a.o_orderkey AS k, count(*) AS n, max(b.o_totalprice) AS top FROM orders a JOIN orders b ON "
  "a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey GROUP BY 1")
q("comma_pattern", "MATCH (a:Region), (b:Region) WHERE a.regionkey < b.regionkey RETURN a.name AS a, b.name AS b",
  "SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
q("optional_match", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) RETURN c.custkey AS k, count(o) AS n",
  "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
q("optional_where",
  "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > c.acctbal * 40 RETURN "
  "c.custkey AS k, o.orderkey AS o",
  "SELECT c_custkey AS k, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 40")
q("optional_chain", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o)-[l:CONTAINS]->(p:Part {size: 10}) RETURN c.custkey AS k, count(p) AS n",
  "SELECT c_custkey AS k, count(p_partkey) AS n FROM customer LEFT JOIN (orders JOIN lineitem ON l_orderkey "
  "= o_orderkey JOIN part ON p_partkey = l_partkey AND p_size = 10) ON o_custkey = c_custkey GROUP BY 1")
q("exists_subquery", "MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 400000 } RETURN c.custkey AS k",
  "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
q("not_exists", "MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->() RETURN count(*) AS n",
  "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
q("exists_under_or",
  "MATCH (c:Customer) WHERE c.acctbal > 9000 OR EXISTS { (c)-[:PLACED]->(:Order {orderpriority: "
  "'1-URGENT'}) } RETURN count(*) AS n",
  "SELECT count(*) AS n FROM customer WHERE c_acctbal > 9000 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
q("count_subquery", "MATCH (c:Customer) RETURN c.custkey AS k, COUNT { (c)-[:PLACED]->(o) WHERE o.orderstatus = 'F' } AS n",
  "SELECT c_custkey AS k, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n FROM customer")
q("pattern_comprehension",
  "MATCH (c:Customer) RETURN c.custkey AS k, list_sum([(c)-[:PLACED]->(o:Order) WHERE o.totalprice > 200000 "
  "| o.orderkey]) AS s",
  "SELECT c_custkey AS k, CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS s FROM customer LEFT JOIN orders "
  "ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY 1")
q("call_subquery",
  "MATCH (c:Customer) CALL { WITH c MATCH (c)-[:PLACED]->(o:Order) RETURN count(o) AS n, max(o.totalprice) "
  "AS top } RETURN c.custkey AS k, n, top",
  "SELECT c_custkey AS k, count(o_orderkey) AS n, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
q("call_top_per_row",
  "MATCH (r:Region) CALL { WITH r MATCH (r)<-[:IN_REGION]-(n:Nation) RETURN n.name AS name ORDER BY name "
  "LIMIT 2 } RETURN r.name AS region, name",
  "SELECT region, name FROM (SELECT r_name AS region, n_name AS name, row_number() OVER (PARTITION BY "
  "r_name ORDER BY n_name) AS i FROM region JOIN nation ON n_regionkey = r_regionkey) WHERE i <= 2")
q("call_duplicates", "UNWIND [1, 1, 2] AS x CALL { WITH x UNWIND range(1, x) AS y RETURN sum(y) AS s } RETURN x, s",
  "SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT), (1, 1), (2, 3)) AS t(x, s)")
q("multi_type", "MATCH (o:Order)-[r:CONTAINS|SUPPLIED_BY]->(x) RETURN type(r) AS t, label(x) AS l, count(*) AS n",
  "SELECT 'CONTAINS' AS t, 'Part' AS l, count(*) AS n FROM lineitem UNION ALL SELECT 'SUPPLIED_BY', 'Supplier', count(*) FROM lineitem")
# --- paths ----------------------------------------------------------------------------------
NEXT = "WITH RECURSIVE e AS (SELECT n_nationkey AS id, n_nationkey AS a, CAST((n_nationkey * 7 + 3) % 25 AS INT) AS b FROM nation), t AS (SELECT a AS s, b AS c, [id] AS trail FROM e UNION ALL SELECT t.s, e.b, list_append(t.trail, e.id) FROM t JOIN e ON e.a = t.c WHERE NOT list_contains(t.trail, e.id)) "
q("varlen_bounded", "MATCH (a:Nation)-[:NEIGHBOUR*1..3]->(b:Nation) RETURN a.nationkey AS a, b.nationkey AS b, count(*) AS n",
  NEXT + "SELECT s AS a, c AS b, count(*) AS n FROM t WHERE len(trail) <= 3 GROUP BY 1, 2")
q("varlen_zero", "MATCH (a:Nation)-[:NEIGHBOUR*0..1]->(b:Nation) RETURN a.nationkey AS a, b.nationkey AS b",
  NEXT + "SELECT s AS a, c AS b FROM t WHERE len(trail) <= 1 UNION ALL SELECT n_nationkey, n_nationkey FROM nation")
q("varlen_exact", "MATCH p = (a:Nation)-[:NEIGHBOUR*2]->(b:Nation) RETURN a.nationkey AS a, b.nationkey AS b, length(p) AS n",
  NEXT + "SELECT s AS a, c AS b, len(trail)::BIGINT AS n FROM t WHERE len(trail) = 2")
q("trail_unbounded", "MATCH (a:Nation)-[r:NEIGHBOUR*]->(b:Nation) RETURN a.nationkey AS a, b.nationkey AS b, size(r) AS n",
  NEXT + "SELECT s AS a, c AS b, len(trail)::BIGINT AS n FROM t")
q("shortest_path",
  "MATCH p = shortestPath((a:Nation)-[:NEIGHBOUR*]->(b:Nation)) WHERE a <> b RETURN a.nationkey AS a, "
  "b.nationkey AS b, length(p) AS n",
  NEXT + "SELECT s AS a, c AS b, min(len(trail))::BIGINT AS n FROM t WHERE s <> c GROUP BY 1, 2")
q("path_functions",
  "MATCH p = (c:Customer)-[:FROM_NATION]->(n)-[:IN_REGION]->(r) RETURN c.custkey AS k, length(p) AS hops, "
  "size(nodes(p)) AS nodes, [x IN relationships(p) | type(x)][1] AS last, is_acyclic(p) AS simple",
  "SELECT c_custkey AS k, 2::BIGINT AS hops, 3::BIGINT AS nodes, 'IN_REGION' AS last, true AS simple FROM customer")
# --- projection, sorting, sets --------------------------------------------------------------
q("with_having", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(*) AS n WHERE n > 15 RETURN c.custkey AS k, n",
  "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
q("order_skip_limit", "MATCH (o:Order) RETURN o.orderkey AS k, o.totalprice AS p ORDER BY p DESC, k SKIP 5 LIMIT 10",
  "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 10 OFFSET 5")
q("order_by_hidden", "MATCH (o:Order) RETURN o.orderkey AS k ORDER BY o.totalprice DESC, o.orderkey LIMIT 7",
  "SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
q("order_nulls", "UNWIND [3, null, 1] AS x WITH x ORDER BY x DESC WITH collect(coalesce(x, 99)) AS xs RETURN xs[0] AS first, xs[2] AS last",
  "SELECT 99::BIGINT AS first, 1::BIGINT AS last")
q("dynamic_limit", "MATCH (r:Region) RETURN r.name AS name ORDER BY name LIMIT 1 + toInteger($n)",
  "SELECT r_name AS name FROM region ORDER BY 1 LIMIT 3", n="2")
q("distinct_rows", "MATCH (p:Part) RETURN DISTINCT p.brand AS brand, p.size AS size", "SELECT DISTINCT p_brand AS brand, p_size AS size FROM part")
q("distinct_nodes", "MATCH (o:Order)<-[:PLACED]-(c) WHERE o.totalprice > 300000 WITH DISTINCT c RETURN count(c) AS n",
  "SELECT count(DISTINCT o_custkey) AS n FROM orders WHERE o_totalprice > 300000")
q("union_all", "MATCH (c:Customer) RETURN c.nationkey AS n UNION ALL MATCH (s:Supplier) RETURN s.nationkey AS n",
  "SELECT c_nationkey AS n FROM customer UNION ALL SELECT s_nationkey FROM supplier")
q("union_distinct", "MATCH (c:Customer) RETURN c.nationkey AS n UNION MATCH (s:Supplier) RETURN s.nationkey AS n",
  "SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier")
q("unwind_list", "UNWIND [1, 2, 3] AS x UNWIND ['a', 'b'] AS y RETURN x, y, x * 10 AS z",
  "SELECT x, y, x * 10 AS z FROM (VALUES (1::BIGINT), (2), (3)) a(x), (VALUES ('a'), ('b')) b(y)")
q("return_star", "MATCH (r:Region) WITH r.regionkey AS k, r.name AS name RETURN *", "SELECT r_regionkey AS k, r_name AS name FROM region")
q("procedure_labels", "CALL db.labels() YIELD label WHERE label STARTS WITH 'P' RETURN label",
  "SELECT unnest(['Page', 'Part', 'Party', 'Passage']) AS label")
# --- aggregation ----------------------------------------------------------------------------
q("agg_basic",
  "MATCH (o:Order) RETURN o.orderpriority AS p, count(*) AS n, min(o.totalprice) AS lo, max(o.totalprice) "
  "AS hi, round(avg(o.totalprice), 4) AS mean",
  "SELECT o_orderpriority AS p, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, "
  "round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
q("agg_empty",
  "MATCH (o:Order) WHERE o.totalprice < 0 RETURN count(*) AS n, sum(o.custkey) AS s, avg(o.custkey) AS a, "
  "size(collect(o.custkey)) AS c, stDev(o.totalprice) AS d",
  "SELECT 0::BIGINT AS n, 0::BIGINT AS s, NULL::DOUBLE AS a, 0::BIGINT AS c, 0.0::DOUBLE AS d")
q("agg_distinct", "MATCH (o:Order) RETURN count(DISTINCT o.custkey) AS n, sum(DISTINCT o.custkey) AS s, round(avg(DISTINCT o.custkey), 6) AS a",
  "SELECT count(DISTINCT o_custkey) AS n, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s, round(avg(DISTINCT o_custkey), 6) AS a FROM orders")
q("agg_stdev", "MATCH (p:Part) RETURN p.brand AS b, round(stDev(p.retailprice), 4) AS s, round(stDevP(p.retailprice), 4) AS sp",
  "SELECT p_brand AS b, round(coalesce(stddev_samp(p_retailprice), 0), 4) AS s, round(stddev_pop(p_retailprice), 4) AS sp FROM part GROUP BY 1")
q("agg_percentile", "MATCH (p:Part) RETURN p.brand AS b, round(percentileCont(p.retailprice, 0.3), 6) AS c, percentileDisc(p.size, 0.5) AS d",
  "SELECT p_brand AS b, round(quantile_cont(p_retailprice, 0.3), 6) AS c, quantile_disc(p_size, 0.5) AS d FROM part GROUP BY 1")
q("agg_expression", "MATCH (o:Order) RETURN o.orderstatus AS s, count(*) * 2 + max(o.orderkey) AS x",
  "SELECT o_orderstatus AS s, count(*) * 2 + max(o_orderkey) AS x FROM orders GROUP BY 1")
q("collect_ordered",
  "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, n ORDER BY n.name DESC WITH r, collect(n.name) AS "
  "names RETURN r.name AS region, list_join(names, '|') AS names",
  "SELECT r_name AS region, string_agg(n_name, '|' ORDER BY n_name DESC) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
q("collect_distinct", "MATCH (p:Part) WITH p.size % 10 AS g, collect(DISTINCT p.brand) AS bs RETURN g, list_join(bs, ',') AS brands",
  "SELECT p_size::BIGINT % 10 AS g, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM part GROUP BY 1")
q("weighted_count", "MATCH (c:Customer)-[:PLACED]->(o)-[:CONTAINS]->(p) RETURN count(*) AS n",
  "SELECT count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
# --- computed relationships -----------------------------------------------------------------
q("as_of", "MATCH (e:Event)-[:BEFORE]->(o:Order) RETURN e.event_id AS e, o.orderkey AS o",
  "SELECT event_id AS e, o_orderkey AS o FROM (SELECT event_id, o_orderkey, row_number() OVER (PARTITION BY "
  "event_id ORDER BY o_orderdate DESC, o_orderkey) AS i FROM events JOIN orders ON o_custkey = user_id AND "
  "o_orderdate <= ts) WHERE i = 1")
q("top_k_vectors", "MATCH (a:Vector)-[s:SIMILAR]->(b:Vector) RETURN a.vec_id AS a, b.vec_id AS b, s.rank AS rank",
  "SELECT a, b, rank::INTEGER AS rank FROM (SELECT a.vec_id AS a, b.vec_id AS b, row_number() OVER "
  "(PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) "
  "DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 "
  "= 0) WHERE rank <= 3")
q("bm25_search", "MATCH (p:Passage)-[s:MATCHES]->(d:Document) WHERE s.rank = 1 RETURN p.item_id AS p, round(s.score, 6) AS score", """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS ws FROM documents),
q AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM benchmark),
qf AS (SELECT item_id, w, count(*) AS qf FROM q GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM d),
tf AS (SELECT doc_id, w, len AS dl, count(*) AS tf FROM (SELECT doc_id, len(ws) AS len, unnest(ws) AS w FROM d) WHERE w IN (SELECT w FROM q) GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT item_id, doc_id, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS s FROM tf JOIN df USING (w) JOIN qf USING (w), st GROUP BY ALL)
SELECT item_id AS p, round(max(s), 6) AS score FROM sc GROUP BY 1""")
q("theta_relationship", "MATCH (a:Part)-[:SAME_SIZE]->(b:Part) RETURN count(*) AS n",
  "SELECT count(*) AS n FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey")
q("cypher_relationship", "MATCH (c:Customer)-[:BUYS]->(p:Part) RETURN c.custkey AS c, count(p) AS n",
  "SELECT o_custkey AS c, count(DISTINCT l_partkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 48 GROUP BY 1")
# --- expressions ----------------------------------------------------------------------------
q("case_forms",
  "MATCH (p:Part) RETURN p.partkey AS k, CASE WHEN p.size > 30 THEN 'big' WHEN p.size > 10 THEN 'mid' ELSE "
  "'small' END AS c, CASE p.size WHEN 1 THEN 'one' END AS d",
  "SELECT p_partkey AS k, CASE WHEN p_size > 30 THEN 'big' WHEN p_size > 10 THEN 'mid' ELSE 'small' END AS "
  "c, CASE p_size WHEN 1 THEN 'one' END AS d FROM part")
q("three_valued",
  "UNWIND [true, false, null] AS a UNWIND [true, false, null] AS b RETURN a, b, a AND b AS con, a OR b AS "
  "dis, a XOR b AS exc, NOT a AS neg",
  "SELECT a, b, a AND b AS con, a OR b AS dis, (a AND NOT b) OR (NOT a AND b) AS exc, NOT a AS neg FROM "
  "(VALUES (true), (false), (NULL)) x(a), (VALUES (true), (false), (NULL)) y(b)")
q("null_semantics",
  "RETURN 1 = null AS a, null IS NULL AS b, 2 IN [1, null] AS c, 1 IN [1, null] AS d, [1, null] = [1, null] "
  "AS e, 1 = '1' AS f, 1 < 'a' AS g, [1, 2] = [1] AS h",
  "SELECT NULL::BOOLEAN AS a, true AS b, NULL::BOOLEAN AS c, true AS d, NULL::BOOLEAN AS e, false AS f, NULL::BOOLEAN AS g, false AS h")
q("arithmetic",
  "MATCH (p:Part) RETURN p.partkey AS k, p.size / 7 AS quotient, p.size % 7 AS rest, -p.size / 7 AS "
  "negative, p.size * 1.5 AS scaled, 2 ^ (p.size % 5) AS power",
  "SELECT p_partkey AS k, p_size::BIGINT // 7 AS quotient, p_size::BIGINT % 7 AS rest, "
  "trunc(-p_size::BIGINT / 7)::BIGINT AS negative, p_size * 1.5::DOUBLE AS scaled, pow(2, p_size % "
  "5)::DOUBLE AS power FROM part")
q("chained_compare", "MATCH (p:Part) WHERE 10 <= p.size < 12 RETURN p.partkey AS k",
  "SELECT p_partkey AS k FROM part WHERE p_size >= 10 AND p_size < 12")
q("in_list", "MATCH (p:Part) WHERE p.size IN $sizes RETURN count(*) AS n",
  "SELECT count(*) AS n FROM part WHERE p_size IN (1, 5, 9)", sizes=[1, 5, 9])
q("regex", "MATCH (c:Customer) WHERE c.name =~ 'Customer#0+1[0-9]' RETURN c.name AS name",
  "SELECT c_name AS name FROM customer WHERE regexp_full_match(c_name, 'Customer#0+1[0-9]')")
q("list_comprehension", "MATCH (p:Part) RETURN p.partkey AS k, list_sum([x IN range(1, p.size) WHERE x % 3 = 0 | x * x]) AS s",
  "SELECT p_partkey AS k, CAST(coalesce(list_sum(list_transform(list_filter(range(1, p_size::BIGINT + 1), "
  "lambda x: x % 3 = 0), lambda x: x * x)), 0) AS BIGINT) AS s FROM part")
q("quantifiers",
  "UNWIND [[1, 2], [2, 4], [1, 3]] AS xs RETURN xs[0] AS a, xs[1] AS b, all(x IN xs WHERE x % 2 = 0) AS al, "
  "any(x IN xs WHERE x % 2 = 0) AS an, none(x IN xs WHERE x % 2 = 0) AS no, single(x IN xs WHERE x % 2 = 0) "
  "AS si",
  "SELECT * FROM (VALUES (1::BIGINT, 2::BIGINT, false, true, false, true), (2, 4, true, true, false, "
  "false), (1, 3, false, false, true, false)) t(a, b, al, an, no, si)")
q("reduce_list", "MATCH (p:Part) RETURN p.partkey AS k, reduce(s = 0, x IN range(1, p.size) | s + x) AS total",
  "SELECT p_partkey AS k, p_size::BIGINT * (p_size + 1) // 2 AS total FROM part")
q("subscripts",
  "WITH [10, 20, 30, 40] AS xs RETURN xs[0] AS a, xs[-1] AS b, xs[9] AS c, size(xs[1..3]) AS d, xs[1..][0] "
  "AS e, {k: 7}.k AS f, {k: 7}['k'] AS g, size(xs[null..2]) AS h",
  "SELECT 10::BIGINT AS a, 40::BIGINT AS b, NULL::BIGINT AS c, 2::BIGINT AS d, 20::BIGINT AS e, 7::BIGINT AS f, 7::BIGINT AS g, NULL::BIGINT AS h")
q("string_functions",
  "MATCH (p:Part) RETURN p.partkey AS k, toUpper(p.name) AS u, substring(p.name, 2, 3) AS s, left(p.brand, "
  "5) AS l, right(p.brand, 2) AS r, replace(p.type, 'A', '_') AS rep, size(p.name) AS n, reverse(p.brand) "
  "AS rev, split(p.brand, '#')[1] AS part, lpad(p.brand, 12, '*') AS pad, p.name CONTAINS '1' AS has, "
  "trim('  x ') AS t",
  "SELECT p_partkey AS k, upper(p_name) AS u, substr(p_name, 3, 3) AS s, left(p_brand, 5) AS l, "
  "right(p_brand, 2) AS r, replace(p_type, 'A', '_') AS rep, length(p_name) AS n, reverse(p_brand) AS rev, "
  "split_part(p_brand, '#', 2) AS part, lpad(p_brand, 12, '*') AS pad, contains(p_name, '1') AS has, 'x' AS "
  "t FROM part")
q("regex_functions",
  "MATCH (c:Customer) RETURN c.custkey AS k, regexp_replace(c.name, '0', 'x') AS one, "
  "regexp_replace(c.name, '0', 'x', 'g') AS every, regexp_extract(c.name, '([A-Z])([a-z]+)', 2) AS word, "
  "levenshtein(c.name, 'Customer') AS d, md5(c.name) AS h",
  "SELECT c_custkey AS k, regexp_replace(c_name, '0', 'x') AS one, regexp_replace(c_name, '0', 'x', 'g') AS "
  "every, regexp_extract(c_name, '([A-Z])([a-z]+)', 2) AS word, levenshtein(c_name, 'Customer')::INTEGER AS "
  "d, md5(c_name) AS h FROM customer")
q("math_functions",
  "MATCH (p:Part) RETURN p.partkey AS k, ceil(p.retailprice) AS c, floor(p.retailprice) AS f, abs(p.size - "
  "25) AS a, sign(p.size - 25) AS s, round(sqrt(p.size), 6) AS q, round(log(p.size), 6) AS l, "
  "round(exp(p.size / 50.0), 6) AS e, even(p.size) AS ev, p.size & 3 AS bits, round(degrees(p.size), 6) AS "
  "deg",
  "SELECT p_partkey AS k, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, abs(p_size - 25)::BIGINT AS "
  "a, sign(p_size - 25)::BIGINT AS s, round(sqrt(p_size), 6) AS q, round(log10(p_size), 6) AS l, "
  "round(exp(p_size / 50.0::DOUBLE), 6) AS e, even(p_size)::DOUBLE AS ev, p_size::BIGINT & 3 AS bits, "
  "round(degrees(p_size), 6) AS deg FROM part")
q("log_limits", "RETURN ln(0) AS a, isNaN(ln(-1)) AS b, 1.0 / 0 AS c, gcd(12, 18) AS d, factorial(5) AS e, 5! AS f",
  "SELECT '-inf'::DOUBLE AS a, true AS b, 'inf'::DOUBLE AS c, 6::BIGINT AS d, 120::BIGINT AS e, 120::BIGINT AS f")
q("list_functions",
  "WITH [3, 1, 2, 3] AS xs RETURN list_sum(xs) AS s, list_min(xs) AS lo, list_max(xs) AS hi, "
  "list_position(xs, 2) AS p, list_contains(xs, 9) AS c, list_unique(xs) AS u, list_sort(xs)[0] AS f, "
  "list_avg(xs) AS a, size(list_concat(xs, [7])) AS n, head(xs) AS h, last(xs) AS l, size(tail(xs)) AS t, "
  "list_product(xs) AS pr, list_join(list_transform(xs, x -> x + 1), '-') AS j",
  "SELECT 9::BIGINT AS s, 1::BIGINT AS lo, 3::BIGINT AS hi, 3::BIGINT AS p, false AS c, 3::BIGINT AS u, "
  "1::BIGINT AS f, 2.25::DOUBLE AS a, 5::BIGINT AS n, 3::BIGINT AS h, 3::BIGINT AS l, 3::BIGINT AS t, "
  "18::BIGINT AS pr, '4-2-3-4' AS j")
q("casts",
  "RETURN toInteger('42') AS a, toInteger('1.7') AS b, toInteger('x') AS c, toFloat('2.5') AS d, "
  "toBoolean('TRUE') AS e, toString(12) AS f, CAST('7' AS INT64) AS g, typeof(1.5) AS h, toString([1, 2]) "
  "AS i",
  "SELECT 42::BIGINT AS a, 1::BIGINT AS b, NULL::BIGINT AS c, 2.5::DOUBLE AS d, true AS e, '12' AS f, 7::BIGINT AS g, 'DOUBLE' AS h, '[1,2]' AS i")
q("temporal_parts",
  "MATCH (o:Order) RETURN o.orderkey AS k, o.orderdate.year AS y, o.orderdate.month AS m, o.orderdate.day "
  "AS d, date_part('quarter', o.orderdate) AS q, dayname(o.orderdate) AS n, date_trunc('month', "
  "o.orderdate) AS t",
  "SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, "
  "quarter(o_orderdate) AS q, dayname(o_orderdate) AS n, date_trunc('month', o_orderdate)::TIMESTAMP AS t "
  "FROM orders")
q("temporal_arithmetic",
  "RETURN date('2020-01-31') + duration({months: 1}) AS a, date({year: 2021, week: 1}) AS b, "
  "toString(duration.between(date('2019-03-01'), date('2021-05-20'))) AS c, date('2020-03-01') - "
  "date('2020-02-01') AS d, toString(duration('P1Y2M3DT4H5M6S')) AS e, localdatetime({year: 2020, month: 5, "
  "day: 6, hour: 7}) AS f, duration.inDays(date('2020-01-01'), date('2020-03-01')).days AS g",
  "SELECT DATE '2020-02-29' AS a, DATE '2021-01-04' AS b, 'P2Y2M19D' AS c, 29::BIGINT AS d, "
  "'P1Y2M3DT4H5M6S' AS e, TIMESTAMP '2020-05-06 07:00:00' AS f, 60::BIGINT AS g")
q("json_functions",
  "MATCH (e:Event) RETURN e.event_id AS id, toInteger(json.value(e.props, '$.k')) AS k, json.type(e.props) "
  "AS t, json.exists(e.props, '$.zz') AS z",
  "SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'object' AS t, false AS z FROM events")
q("json_edit",
  "WITH '{\"a\":{\"b\":[1,2]}}' AS j RETURN json.set(j, '$.a.c', '5') AS s, json.remove(j, '$.a.b') AS r, "
  "json.query(j, '$.a.b[*]') AS q, json.merge_patch(j, '{\"a\":null,\"x\":1}') AS m, "
  "json.array_length('[1,2,3]') AS n",
  "SELECT '{\"a\":{\"b\":[1,2],\"c\":5}}' AS s, '{\"a\":{}}' AS r, '[1,2]' AS q, '{\"x\":1}' AS m, 3::BIGINT AS n")
q("vector_functions",
  "MATCH (a:Vector {vec_id: 0}), (b:Vector) RETURN b.vec_id AS b, round(vector.dot(a.embedding, "
  "b.embedding), 5) AS d, round(vector.l2_distance(a.embedding, b.embedding), 5) AS l",
  "SELECT b.vec_id AS b, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS d, "
  "round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS l FROM embeddings a, embeddings "
  "b WHERE a.vec_id = 0")

q("fn_strings",
  "MATCH (p:Part) RETURN p.partkey AS k, fn.upper(p.name) AS u, fn.strpos(p.name, 'e') AS pos, "
  "fn.translate(p.name, 'aeiou', '12345') AS t, fn.split_part(p.name, ' ', 1) AS w, fn.sha256(p.name) AS h, "
  "fn.rpad(p.brand, 10, '-') AS r, fn.repeat('ab', 2) AS rep, fn.ascii(p.name) AS a, "
  "fn.octet_length(p.name) AS n",
  "SELECT p_partkey AS k, upper(p_name) AS u, strpos(p_name, 'e')::INTEGER AS pos, translate(p_name, "
  "'aeiou', '12345') AS t, split_part(p_name, ' ', 1) AS w, sha256(p_name) AS h, rpad(p_brand, 10, '-') AS "
  "r, 'abab' AS rep, ascii(p_name)::INTEGER AS a, strlen(p_name)::INTEGER AS n FROM part")
q("fn_math",
  "MATCH (p:Part) RETURN p.partkey AS k, round(fn.cbrt(p.size), 6) AS c, fn.trunc(p.retailprice) AS t, "
  "round(fn.atan2(p.size, 3), 6) AS a, fn.lcm(p.size, 6) AS l, fn.greatest(p.size, 25) AS g, "
  "fn.least(p.size, 25) AS s, round(fn.tanh(p.size / 50.0), 6) AS h, fn.iszero(p.size - 1) AS z",
  "SELECT p_partkey AS k, round(cbrt(p_size), 6) AS c, trunc(p_retailprice) AS t, round(atan2(p_size, 3), "
  "6) AS a, lcm(p_size, 6)::BIGINT AS l, greatest(p_size, 25)::BIGINT AS g, least(p_size, 25)::BIGINT AS s, "
  "round(tanh(p_size / 50.0::DOUBLE), 6) AS h, p_size = 1 AS z FROM part")
q("fn_arrays",
  "WITH [5, 3, 5, null] AS xs RETURN fn.cardinality(fn.array_distinct(xs)) AS a, fn.array_min(xs) AS b, "
  "fn.array_position(xs, 3) AS c, fn.cardinality(fn.array_remove_all(xs, 5)) AS d, fn.array_has_any(xs, [3, "
  "9]) AS e, fn.array_to_string([1, 2, 3], '-') AS f, fn.array_element(xs, -2) AS g, fn.array_reverse([1, "
  "2])[0] AS h, fn.array_union([1], [2, 1])[1] AS i, fn.array_except([1, 2], [2])[0] AS j, fn.flatten([[1], "
  "[2, 3]])[2] AS l, fn.array_repeat(7, 3)[2] AS m",
  "SELECT 3::BIGINT AS a, 3::BIGINT AS b, 2::BIGINT AS c, 2::BIGINT AS d, true AS e, '1-2-3' AS f, "
  "5::BIGINT AS g, 2::BIGINT AS h, 2::BIGINT AS i, 1::BIGINT AS j, 3::BIGINT AS l, 7::BIGINT AS m")
q("fn_times",
  "MATCH (o:Order) RETURN o.orderkey AS k, fn.date_part('doy', o.orderdate) AS d, fn.to_char(o.orderdate, "
  "'yyyy-MM') AS c, last_day(o.orderdate) AS l, fn.to_unixtime(o.orderdate) AS u, century(o.orderdate) AS "
  "ce, date_add('days', 40, o.orderdate) AS p, make_date(2020, 13, 1) AS bad",
  "SELECT o_orderkey AS k, dayofyear(o_orderdate) AS d, strftime(o_orderdate, '%Y-%m') AS c, "
  "last_day(o_orderdate) AS l, epoch(o_orderdate)::BIGINT AS u, century(o_orderdate) AS ce, o_orderdate + "
  "INTERVAL 40 DAY AS p, NULL::DATE AS bad FROM orders")
q("fn_conditional", "UNWIND [1, null, 3] AS x RETURN fn.coalesce(x, 0) AS a, fn.nullif(x, 3) AS b, fn.nvl2(x, 'set', 'none') AS c, ifnull(x, 9) AS d",
  "SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT, 'set', 1::BIGINT), (0, NULL, 'none', 9), (3, NULL, 'set', 3)) t(a, b, c, d)")
q("fn_maps",
  "WITH {a: 1, b: 2} AS m RETURN keys(m)[0] AS k, m.b AS b, map_keys(map(['x', 'y'], [1, 2]))[1] AS mk, "
  "map_extract(map(['x'], [4]), 'x')[0] AS me, struct_extract(m, 'a') AS s, size(m) AS n, "
  "union_tag(union_value('t', 5)) AS u",
  "SELECT 'a' AS k, 2::BIGINT AS b, 'y' AS mk, 4::BIGINT AS me, 1::BIGINT AS s, 2::BIGINT AS n, 't' AS u")
q("strict_casts",
  "RETURN to_int32('12') AS a, to_double('1.5') AS b, to_uint8(200) AS c, cast(1.9, 'STRING') AS d, "
  "to_string(true) AS e, tobool('true') AS f, CAST(3 AS DOUBLE) AS g, "
  "uuid('A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11') AS h",
  "SELECT 12::INTEGER AS a, 1.5::DOUBLE AS b, 200::SMALLINT AS c, '1.9' AS d, 'true' AS e, true AS f, "
  "3.0::DOUBLE AS g, 'a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11' AS h")
q("durations",
  "WITH duration({days: 3, hours: 5}) AS d RETURN d.days AS days, d.hours AS hours, toString(d * 2) AS "
  "twice, toString(d + duration({hours: 20})) AS more, toString(to_minutes(90)) AS m, "
  "toString(localdatetime('2020-01-31T10:00:00') + duration({months: 1, hours: 3})) AS t, "
  "toString(duration.inSeconds(localdatetime('2020-01-01T00:00:00'), localdatetime('2020-01-02T01:00:00'))) "
  "AS s",
  "SELECT 3::BIGINT AS days, 5::BIGINT AS hours, 'P6DT10H' AS twice, 'P3DT25H' AS more, 'PT1H30M' AS m, '2020-02-29 13:00:00' AS t, 'PT25H' AS s")
q("source_query_label", "MATCH (b:BigOrder)<-[:PLACED_BIG]-(c:Customer) RETURN c.custkey AS c, count(b) AS n",
  "SELECT o_custkey AS c, count(*) AS n FROM orders WHERE o_totalprice > 350000 GROUP BY 1")
q("collection_source", "MATCH (v:Vector)-[:HAS_VALUE]->(x:Component) RETURN v.vec_id AS v, x.position AS i, x.value AS value",
  "SELECT vec_id AS v, (i - 1)::INTEGER AS i, embedding[i]::DOUBLE AS value FROM embeddings, range(1, 65) r(i) WHERE i <= len(embedding)")
q("table_function", "MATCH (n:Number) RETURN n.value AS v", "SELECT range AS v FROM range(0, 100)")
q("collect_subquery", "MATCH (r:Region) RETURN r.name AS region, size(COLLECT { MATCH (r)<-[:IN_REGION]-(n) RETURN n.name }) AS n",
  "SELECT r_name AS region, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
q("exists_full_query", "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o) WITH count(o) AS n WHERE n > 12 RETURN n } RETURN c.custkey AS k",
  "SELECT o_custkey AS k FROM orders GROUP BY 1 HAVING count(*) > 12")


from . import families  # noqa: E402, F401  further queries, by family of operators and functions


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(text: str | Callable, params: dict[str, Any]) -> Callable[[SparkSession, str], DataFrame]:
        if callable(text):
            return text
        return lambda spark, sf_dir: graph(spark, sf_dir).cypher(text, **params)

    return {n: runner(text, params) for n, (text, params, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, _, sql) in QUERIES.items() if sql is not None}
