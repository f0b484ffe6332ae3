"""Further named queries: element values, walks, subqueries, writes, changes, policies and functions by family."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .demo import graph
from .graph import Graph
from .policy import Policy
from .queries import NEXT, q
from .sources.mapping import from_dict
from .store import Store
from .streaming import changes

# --- element values and walks ---------------------------------------------------------------
q("path_node_values",
  "MATCH p = (c:Customer)-[:FROM_NATION]->(n)-[:IN_REGION]->(r) RETURN c.custkey AS k, [x IN nodes(p) | "
  "x.name][1] AS nation, nodes(p)[2].name AS region, [x IN nodes(p) | label(x)][0] AS l",
  "SELECT c_custkey AS k, n_name AS nation, r_name AS region, 'Customer' AS l FROM customer JOIN nation ON "
  "c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
q("path_relationship_values",
  "MATCH p = (o:Order)-[:CONTAINS]->(x:Part) WHERE x.size = 7 RETURN o.orderkey AS o, "
  "relationships(p)[0].quantity AS q, [r IN relationships(p) | r.tax][0] AS t, type(relationships(p)[0]) AS "
  "ty",
  "SELECT l_orderkey AS o, l_quantity AS q, l_tax AS t, 'CONTAINS' AS ty FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 7")
q("walk_node_values", "MATCH p = (a:Nation)-[:NEIGHBOUR*1..3]->(b) RETURN a.name AS a, list_join([n IN nodes(p) | n.name], '>') AS names",
  NEXT +
  "SELECT x.n_name AS a, (SELECT string_agg(n_name, '>' ORDER BY i) FROM (SELECT unnest(t.trail) AS k, "
  "generate_subscripts(t.trail, 1) AS i) JOIN nation ON n_nationkey = k) || '>' || y.n_name AS names FROM t "
  "JOIN nation x ON x.n_nationkey = s JOIN nation y ON y.n_nationkey = c WHERE len(trail) <= 3")
q("relationship_ends",
  "MATCH (c)-[r:PLACED]->(o:Order) WHERE o.totalprice > 200000 RETURN o.orderkey AS k, startNode(r).name AS "
  "name, endNode(r).totalprice AS price, startNode(r) = c AS same",
  "SELECT o_orderkey AS k, c_name AS name, o_totalprice AS price, true AS same FROM orders JOIN customer ON "
  "o_custkey = c_custkey WHERE o_totalprice > 200000")
q("rebound_node",
  "MATCH p = (s:Supplier)-[:FROM_NATION]->() WITH nodes(p)[1] AS n MATCH (n)-[:IN_REGION]->(r) RETURN "
  "r.name AS region, count(*) AS n",
  "SELECT r_name AS region, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
q("step_filter",
  "MATCH (a:Nation)-[r:NEIGHBOUR*1..3 (s, n | WHERE type(s) = 'NEIGHBOUR')]->(b) RETURN a.nationkey AS a, "
  "b.nationkey AS b, size(r) AS n",
  NEXT + "SELECT s AS a, c AS b, len(trail)::BIGINT AS n FROM t WHERE len(trail) <= 3")
WALK = "WITH RECURSIVE e AS (SELECT n_nationkey AS id, n_nationkey AS a, CAST((n_nationkey * 7 + 3) % 25 AS INT) AS b FROM nation), w AS (SELECT a AS s, b AS c, [id] AS rels, [a, b] AS met FROM e UNION ALL SELECT w.s, e.b, list_append(w.rels, e.id), list_append(w.met, e.b) FROM w JOIN e ON e.a = w.c WHERE len(w.rels) < 5) "
q("walk_any", "MATCH (a:Nation)-[r:NEIGHBOUR* WALK 1..5]->(b) RETURN a.nationkey AS a, b.nationkey AS b, size(r) AS n",
  WALK + "SELECT s AS a, c AS b, len(rels)::BIGINT AS n FROM w")
q("walk_acyclic", "MATCH (a:Nation)-[r:NEIGHBOUR* ACYCLIC 1..5]->(b) RETURN a.nationkey AS a, b.nationkey AS b, size(r) AS n",
  WALK + "SELECT s AS a, c AS b, len(rels)::BIGINT AS n FROM w WHERE len(list_distinct(met)) = len(met)")
q("walk_simple", "MATCH (a:Nation)-[r:NEIGHBOUR* SIMPLE 1..5]->(b) RETURN a.nationkey AS a, b.nationkey AS b, size(r) AS n",
  WALK +
  "SELECT s AS a, c AS b, len(rels)::BIGINT AS n FROM w WHERE len(list_distinct(rels)) = len(rels) AND "
  "len(list_distinct(met[2:])) = len(met) - 1 AND NOT list_contains(met[2:-2], s)")
q("shortest_from_two",
  "MATCH p = shortestPath((a:Nation)-[:NEIGHBOUR*2..]->(b:Nation)) WHERE a <> b RETURN a.nationkey AS a, "
  "b.nationkey AS b, length(p) AS n",
  NEXT + "SELECT s AS a, c AS b, min(len(trail))::BIGINT AS n FROM t WHERE s <> c AND len(trail) >= 2 GROUP BY 1, 2")
q("shortest_bounded",
  "MATCH p = shortestPath((a:Nation)-[:NEIGHBOUR*0..4]->(b:Nation)) RETURN a.nationkey AS a, b.nationkey AS "
  "b, length(p) AS n, size(nodes(p)) AS m",
  NEXT +
  "SELECT a, b, n, n + 1 AS m FROM (SELECT s AS a, c AS b, min(len(trail))::BIGINT AS n FROM t WHERE s <> c "
  "AND len(trail) <= 4 GROUP BY 1, 2 UNION ALL SELECT n_nationkey, n_nationkey, 0 FROM nation)")
q("shortest_all",
  "MATCH p = allShortestPaths((a:Nation)-[:NEIGHBOUR*]->(b:Nation)) WHERE a <> b RETURN a.nationkey AS a, "
  "b.nationkey AS b, count(*) AS n, min(length(p)) AS l",
  NEXT +
  "SELECT a, b, count(*) AS n, min(l)::BIGINT AS l FROM (SELECT s AS a, c AS b, len(trail) AS l, "
  "min(len(trail)) OVER (PARTITION BY s, c) AS least FROM t WHERE s <> c) WHERE l = least GROUP BY 1, 2")
q("shortest_undirected",
  "MATCH (a:Nation)-[r:NEIGHBOUR* SHORTEST]-(b:Nation) WHERE a.nationkey < b.nationkey RETURN a.nationkey "
  "AS a, b.nationkey AS b, size(r) AS n",
  "WITH RECURSIVE e AS (SELECT n_nationkey AS a, CAST((n_nationkey * 7 + 3) % 25 AS INT) AS b FROM nation), "
  "u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS s, b AS c, 1 AS l FROM u UNION "
  "SELECT r.s, u.b, r.l + 1 FROM r JOIN u ON u.a = r.c WHERE r.l < 25) SELECT s AS a, c AS b, "
  "min(l)::BIGINT AS n FROM r WHERE s < c GROUP BY 1, 2")

# --- subqueries with outer values -----------------------------------------------------------
q("count_outer_value",
  "UNWIND [100000, 300000] AS x MATCH (c:Customer) RETURN x, c.custkey AS k, COUNT { (c)-[:PLACED]->(o) "
  "WHERE o.totalprice > x } AS n",
  "SELECT x::BIGINT AS x, c_custkey AS k, count(o_orderkey) AS n FROM (VALUES (100000), (300000)) v(x) "
  "CROSS JOIN customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > x GROUP BY 1, 2")
q("comprehension_outer_value",
  "UNWIND [2, 3] AS f MATCH (r:Region) RETURN r.name AS r, list_sum([(r)<-[:IN_REGION]-(n) WHERE "
  "n.nationkey % f = 0 | n.nationkey * f]) AS s, f",
  "SELECT r_name AS r, coalesce(sum(n_nationkey * f), 0)::BIGINT AS s, f::BIGINT AS f FROM (VALUES (2), "
  "(3)) v(f) CROSS JOIN region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey % f = 0 GROUP "
  "BY 1, 3")
q("collect_outer_value", "UNWIND [5, 40] AS x RETURN x, size(COLLECT { MATCH (p:Part) WHERE p.size > x RETURN p.partkey }) AS n",
  "SELECT x::BIGINT AS x, count(*) AS n FROM (VALUES (5), (40)) v(x) JOIN part ON p_size > x GROUP BY 1")
q("optional_outer_value",
  "UNWIND ['F', 'O'] AS s MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order {orderstatus: s}) "
  "RETURN s, c.custkey AS k, count(o) AS n",
  "SELECT s, c_custkey AS k, count(o_orderkey) AS n FROM (VALUES ('F'), ('O')) v(s) CROSS JOIN customer "
  "LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = s GROUP BY 1, 2")
q("optional_nested_exists",
  "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o) WHERE EXISTS { (o)-[l:CONTAINS]->() WHERE "
  "l.quantity > 49 AND l.tax > 0.07 AND c.acctbal > 0 } RETURN c.custkey AS k, count(o) AS n",
  "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey "
  "AND c_acctbal > 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49 AND l_tax > "
  "0.07) GROUP BY 1")
q("exists_outer_value",
  "UNWIND [1, 3] AS x MATCH (r:Region) WHERE EXISTS { (r)<-[:IN_REGION]-(n:Nation) WHERE n.nationkey % 5 = "
  "x } RETURN x, r.name AS r",
  "SELECT DISTINCT x::BIGINT AS x, r_name AS r FROM (VALUES (1), (3)) v(x) JOIN nation ON n_nationkey % 5 = "
  "x JOIN region ON n_regionkey = r_regionkey")
q("unwind_null_and_scalar", "UNWIND [null, 'a'] AS s UNWIND s AS x RETURN x", "SELECT 'a' AS x")
q("first_seen_distinct",
  "MATCH (o:Order) WITH o.orderpriority AS p ORDER BY o.totalprice DESC, o.orderkey WITH collect(DISTINCT "
  "p) AS ps RETURN list_join(ps, '|') AS ps",
  "SELECT string_agg(p, '|' ORDER BY t DESC, k) AS ps FROM (SELECT o_orderpriority AS p, max(o_totalprice) "
  "AS t, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS k FROM orders GROUP BY 1)")
q("union_coercion", "MATCH (p:Part) RETURN p.size AS x UNION ALL MATCH (p:Part) RETURN p.retailprice AS x",
  "SELECT p_size::DOUBLE AS x FROM part UNION ALL SELECT p_retailprice FROM part")
q("procedure_types", "CALL db.relationshipTypes() YIELD relationshipType AS t WHERE t STARTS WITH 'P' RETURN t",
  "SELECT unnest(['PLACED', 'PLACED_BIG']) AS t")
q("procedure_keys", "CALL db.propertyKeys() YIELD propertyKey AS k WHERE k STARTS WITH 'n' RETURN k",
  "SELECT unnest(['n_chars', 'name', 'nationkey']) AS k")
q("agg_count_if", "MATCH (p:Part) RETURN p.brand AS b, count_if(p.size > 25) AS n, count_if(p.size % 2) AS odd",
  "SELECT p_brand AS b, count(*) FILTER (p_size > 25) AS n, count(*) FILTER (p_size % 2 <> 0) AS odd FROM part GROUP BY 1")
q("agg_json",
  "MATCH (n:Nation)-[:IN_REGION]->(r) RETURN r.name AS r, json.array_length(json.array_agg(n.name)) AS a, "
  "size(json.keys(json.object_agg(n.name, n.nationkey))) AS o",
  "SELECT r_name AS r, count(*) AS a, count(*) AS o FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
q("agg_durations", "MATCH (p:Part) RETURN toString(sum(duration({days: p.size}))) AS d", "SELECT 'P' || sum(p_size) || 'D' AS d FROM part")
q("literals_and_comments", "/* hex, octal */ RETURN 0x1F AS a, 0o17 AS b, 1e3 AS c, 'it''s' = \"it's\" AS d, `x y` AS e // the end\n".replace("RETURN",
  "WITH 5 AS `x y` RETURN").replace("'it''s' = \"it's\"", "'q' = \"q\""),
  "SELECT 31::BIGINT AS a, 15::BIGINT AS b, 1000.0::DOUBLE AS c, true AS d, 5::BIGINT AS e")
q("named_arguments",
  "MATCH (p:Part) RETURN p.partkey AS k, substring(length := 3, start := 1, s := p.name) AS s, "
  "lpad(p.brand, pad := '.', length := 12) AS l",
  "SELECT p_partkey AS k, substr(p_name, 2, 3) AS s, lpad(p_brand, 12, '.') AS l FROM part")
q("bit_operators", "MATCH (p:Part) RETURN p.partkey AS k, p.size & 12 AS a, p.size | 3 AS o, p.size << 2 AS l, p.size >> 1 AS r",
  "SELECT p_partkey AS k, p_size::BIGINT & 12 AS a, p_size::BIGINT | 3 AS o, p_size::BIGINT * 4 AS l, p_size::BIGINT // 2 AS r FROM part")
q("whole_match", "UNWIND ['ab', 'ab\\n', 'xab'] AS s RETURN s =~ 'a.' AS m, regexp_full_match(s, 'a[b]') AS f, regexp_matches(s, 'ab') AS p",
  "SELECT * FROM (VALUES (true, true, true), (false, false, true), (false, false, true)) v(m, f, p)")

# --- functions ------------------------------------------------------------------------------
q("null_functions",
  "UNWIND [1, null, 3] AS x RETURN coalesce(x, 7) AS a, ifnull(x, 8) AS b, nullif(x, 3) AS c, "
  "constant_or_null(5, x) AS d, exists(x) AS e, cypher_eq(x, 1) AS f, cypher_neq(x, 1) AS g, in(x, [1, 2]) "
  "AS h, cypher_in(x, [1, 2]) AS i, cypher_lt(x, 2) AS j, cypher_gte(x, 2) AS k, xor(x = 1, true) AS l, "
  "cypher_order_key(x) AS m, negate(x) AS n",
  "SELECT coalesce(x, 7) AS a, coalesce(x, 8) AS b, nullif(x, 3) AS c, CASE WHEN x IS NOT NULL THEN "
  "5::BIGINT END AS d, x IS NOT NULL AS e, x = 1 AS f, x <> 1 AS g, x IN (1, 2) AS h, x IN (1, 2) AS i, x < "
  "2 AS j, x >= 2 AS k, x <> 1 AS l, x AS m, -x AS n FROM (VALUES (1::BIGINT), (NULL), (3)) v(x)")
q("trigonometry",
  "MATCH (p:Part) WITH DISTINCT p.size AS s RETURN s, round(sin(s), 9) AS a, round(cos(s), 9) AS b, "
  "round(tan(s), 6) AS c, round(cot(s), 6) AS d, round(asin(s / 50.0), 9) AS e, round(acos(s / 50.0), 9) AS "
  "f, round(atan(s), 9) AS g, round(atan2(s, 2), 9) AS h, round(degrees(s), 6) AS i, round(radians(s), 9) "
  "AS j, round(haversin(s), 9) AS k, round(pi(), 9) AS l, round(e(), 9) AS m",
  "SELECT s, round(sin(s), 9) AS a, round(cos(s), 9) AS b, round(tan(s), 6) AS c, round(cot(s), 6) AS d, "
  "round(asin(s / 50.0::DOUBLE), 9) AS e, round(acos(s / 50.0::DOUBLE), 9) AS f, round(atan(s), 9) AS g, "
  "round(atan2(s, 2), 9) AS h, round(degrees(s), 6) AS i, round(radians(s), 9) AS j, round(pow(sin(s / "
  "2.0::DOUBLE), 2), 9) AS k, round(pi(), 9) AS l, round(exp(1.0::DOUBLE), 9) AS m FROM (SELECT DISTINCT "
  "p_size AS s FROM part)")
q("powers_and_logs",
  "MATCH (p:Part) WITH DISTINCT p.size AS s RETURN s, round(cbrt(s), 9) AS a, round(exp(s / 10.0), 6) AS b, "
  "round(ln(s), 9) AS c, round(log(s), 9) AS d, round(log10(s), 9) AS e, round(log2(s), 9) AS f, "
  "round(pow(s, 1.5), 6) AS g, round(gamma(s / 4.0), 4) AS h, round(lgamma(s), 7) AS i, mod(s, 7) AS j, "
  "multiply(s, 3) AS k, odd(s) AS l, greatest(s, 20, 7) AS m, least(s, 20, 70) AS n, abs(-s) AS o, round(s "
  "/ 3.0, 2) AS p, gcd(s, 36) AS q, lcm(s, 4) AS r",
  "SELECT s, round(cbrt(s), 9) AS a, round(exp(s / 10.0::DOUBLE), 6) AS b, round(ln(s), 9) AS c, "
  "round(log10(s), 9) AS d, round(log10(s), 9) AS e, round(log2(s), 9) AS f, round(pow(s, 1.5::DOUBLE), 6) "
  "AS g, round(gamma(s / 4.0::DOUBLE), 4) AS h, round(lgamma(s), 7) AS i, s % 7 AS j, s::BIGINT * 3 AS k, s "
  "% 2 <> 0 AS l, greatest(s, 20, 7)::BIGINT AS m, least(s, 20, 70)::BIGINT AS n, s::BIGINT AS o, round(s / "
  "3.0::DOUBLE, 2) AS p, gcd(s, 36)::BIGINT AS q, lcm(s, 4)::BIGINT AS r FROM (SELECT DISTINCT p_size AS s "
  "FROM part)")
q("bit_functions",
  "MATCH (p:Part) WITH DISTINCT p.size AS s RETURN s, bitwise_and(s, 6) AS a, bitwise_or(s, 9) AS b, "
  "bitshift_left(s, 3) AS c, bitshift_right(s, 2) AS d, 0 <= rand() < 1 AS e, 0 <= random() < 1 AS f",
  "SELECT s, s::BIGINT & 6 AS a, s::BIGINT | 9 AS b, s::BIGINT * 8 AS c, s::BIGINT // 4 AS d, true AS e, "
  "true AS f FROM (SELECT DISTINCT p_size AS s FROM part)")
q("string_cases",
  "MATCH (p:Part) RETURN p.partkey AS k, lower(p.name) AS a, upper(p.name) AS b, lcase(p.name) AS c, "
  "ucase(p.name) AS d, toLower(p.brand) AS e, ltrim('  x') + rtrim('y  ') AS f, isEmpty('') AS g, "
  "substr(p.name, 2, 4) AS h, concat(p.brand, '-', p.name) AS i, concat_ws('/', p.brand, p.type) AS j, "
  "repeat('z', 3) AS l, sha1(p.name) AS m, octet_length(p.name) AS n, string_split(p.brand, '#')[1] AS o, "
  "str_split(p.brand, '#')[0] AS q, string_to_array(p.brand, '#')[1] AS r, split_part(p.brand, '#', 2) AS "
  "s, initcap('two words') AS t, len(p.name) AS u",
  "SELECT p_partkey AS k, lower(p_name) AS a, upper(p_name) AS b, lower(p_name) AS c, upper(p_name) AS d, "
  "lower(p_brand) AS e, 'xy' AS f, true AS g, substr(p_name, 2, 4) AS h, p_brand || '-' || p_name AS i, "
  "concat_ws('/', p_brand, p_type) AS j, 'zzz' AS l, sha1(p_name) AS m, strlen(p_name)::INTEGER AS n, "
  "split_part(p_brand, '#', 2) AS o, split_part(p_brand, '#', 1) AS q, split_part(p_brand, '#', 2) AS r, "
  "split_part(p_brand, '#', 2) AS s, 'Two Words' AS t, length(p_name) AS u FROM part")
q("string_tests",
  "MATCH (p:Part) RETURN p.partkey AS k, contains(p.name, 'a') AS a, starts_with(p.brand, 'B') AS b, "
  "ends_with(p.brand, '1') AS c, startswith(p.name, 'p') AS d, endswith(p.name, 'x') AS e, prefix(p.brand, "
  "'Br') AS f, suffix(p.brand, '#1') AS g, regex_match(p.brand, 'Brand#[0-9]+') AS h, "
  "regexp_matches(p.name, '[aeiou]{2}') AS i, size(regexp_split_to_array(p.type, ' ')) AS j, "
  "size(regexp_extract_all(p.brand, '[0-9]')) AS l, format_placeholder('<{n}>', 'n', p.size) AS m, "
  "format_concat(p.brand, '!') AS n, conjoin(['a', 'b'], '+') AS o, hash(p.name) = hash(p.name) AS q, "
  "decode(encode(p.name)) = p.name AS r",
  "SELECT p_partkey AS k, contains(p_name, 'a') AS a, starts_with(p_brand, 'B') AS b, ends_with(p_brand, "
  "'1') AS c, starts_with(p_name, 'p') AS d, ends_with(p_name, 'x') AS e, starts_with(p_brand, 'Br') AS f, "
  "ends_with(p_brand, '#1') AS g, regexp_full_match(p_brand, 'Brand#[0-9]+') AS h, regexp_matches(p_name, "
  "'[aeiou]{2}') AS i, len(string_split(p_type, ' ')) AS j, len(regexp_extract_all(p_brand, '[0-9]')) AS l, "
  "'<' || p_size || '>' AS m, p_brand || '!' AS n, 'a+b' AS o, true AS q, true AS r FROM part")
q("list_building",
  "MATCH (p:Part) WITH DISTINCT p.size AS s WITH s, [s, 3, 9, 3] AS xs RETURN s, list_append(xs, 5)[4] AS "
  "a, list_prepend(5, xs)[0] AS b, list_concat(xs, [1])[4] AS c, array_concat([1], xs)[0] AS d, "
  "list_element(xs, 1) AS e, list_extract(xs, 2) AS f, array_extract(xs, 3) AS g, element_at(xs, 1) AS h, "
  "list_position(xs, 9) AS i, list_indexof(xs, 3) AS j, array_indexof(xs, 9) AS k, array_position(xs, 9) AS "
  "l, list_has_all(xs, [3, 9]) AS m, array_contains(xs, 3) AS n, list_size(xs) AS o, list_length(xs) AS p, "
  "list_count(xs) AS q, array_length(xs) AS r, cardinality(xs) AS t, size(list_distinct(xs)) AS u, "
  "list_any_value(xs) AS v, list_reverse(xs)[0] AS w, list_reverse_sort(xs)[3] AS x, array_slice(xs, 2, "
  "3)[0] AS y, list_slice(xs, 1, 2)[1] AS z",
  "SELECT s, 5::BIGINT AS a, 5::BIGINT AS b, 1::BIGINT AS c, 1::BIGINT AS d, s::BIGINT AS e, 3::BIGINT AS "
  "f, 9::BIGINT AS g, s::BIGINT AS h, list_position(xs, 9)::BIGINT AS i, list_position(xs, 3)::BIGINT AS j, "
  "list_position(xs, 9)::BIGINT AS k, list_position(xs, 9)::BIGINT AS l, true AS m, true AS n, 4::BIGINT AS "
  "o, 4::BIGINT AS p, 4::BIGINT AS q, 4::BIGINT AS r, 4::BIGINT AS t, len(list_distinct(xs))::BIGINT AS u, "
  "s::BIGINT AS v, 3::BIGINT AS w, list_min(xs)::BIGINT AS x, 3::BIGINT AS y, 3::BIGINT AS z FROM (SELECT "
  "DISTINCT p_size AS s, [p_size, 3, 9, 3] AS xs FROM part)")
q("list_sets",
  "MATCH (p:Part) WITH DISTINCT p.size AS s WITH s, [1, 2, s] AS xs, [2, 7] AS ys RETURN s, "
  "size(list_combine(xs, ys)) AS a, size(list_merge([1, 2], ys)) AS b, list_intersect(xs, ys)[0] AS c, "
  "list_difference([1, 2], ys)[0] AS d, size(list_disjunct([1, 2], ys)) AS e, list_transform(xs, x -> x * "
  "2)[2] AS f, size(list_filter(xs, x -> x > 2)) AS g, list_reduce(xs, (a, b) -> a + b) AS h, "
  "index_list(ys)[1].index AS i, size(set_literal([1, 1, 2])) AS j, list_creation(s, 1)[0] AS k, "
  "array_value(4, s)[1] AS l, appendelement(ys, s, true)[2] AS m, size(appendelement(ys, s, false)) AS n",
  "SELECT s, 5::BIGINT AS a, 3::BIGINT AS b, 2::BIGINT AS c, 1::BIGINT AS d, 2::BIGINT AS e, s::BIGINT * 2 "
  "AS f, (CASE WHEN s > 2 THEN 1 ELSE 0 END)::BIGINT AS g, s::BIGINT + 3 AS h, 1::BIGINT AS i, 2::BIGINT AS "
  "j, s::BIGINT AS k, s::BIGINT AS l, s::BIGINT AS m, 2::BIGINT AS n FROM (SELECT DISTINCT p_size AS s FROM "
  "part)")
q("vector_similarity",
  "MATCH (a:Vector {vec_id: 1}), (b:Vector) RETURN b.vec_id AS b, "
  "round(array_cosine_similarity(a.embedding, b.embedding), 6) AS c, round(array_distance(a.embedding, "
  "b.embedding), 5) AS d, round(array_squared_distance(a.embedding, b.embedding), 4) AS s, "
  "round(array_dot_product(a.embedding, b.embedding), 5) AS p, round(array_inner_product(a.embedding, "
  "b.embedding), 5) AS i, round(vector.cosine_similarity(a.embedding, b.embedding), 6) AS v, "
  "round(vector.maxsim([a.embedding], [b.embedding]), 5) AS m, array_cross_product([1.0, 0.0, 0.0], [0.0, "
  "1.0, 0.0])[2] AS x",
  "SELECT b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS "
  "c, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS d, "
  "round(pow(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2), 4) AS s, "
  "round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS p, "
  "round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS i, "
  "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS v, "
  "round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS m, 1.0::DOUBLE AS x FROM "
  "embeddings a, embeddings b WHERE a.vec_id = 1")
q("map_functions",
  "MATCH (p:Part) WITH DISTINCT p.size AS s WITH s, map(['a', 'b'], [s, 1]) AS m, {x: s, y: 'q'} AS t "
  "RETURN s, map_has_key(m, 'a') AS a, map_get_display(m, 'a') AS b, map_values(m)[0] AS c, map_extract(m, "
  "'zz') = [] AS d, struct_extract(t, 'x') AS e, make_map('k', s)['k'] AS f, struct_pack('n', s).n AS g, "
  "size(keys(t)) AS h, t['y'] AS i, union_extract(union_value('n', s), 'n') AS j, size(map_keys(m)) AS k",
  "SELECT s, true AS a, s AS b, s AS c, true AS d, s AS e, s AS f, s AS g, 2::BIGINT AS h, 'q' AS i, s AS "
  "j, 2::BIGINT AS k FROM (SELECT DISTINCT p_size::BIGINT AS s FROM part)")
q("entity_functions",
  "MATCH (c:Customer)-[r:PLACED]->(o) RETURN id(c) AS a, id(o) AS b, type(r) AS t, label(o) AS l, "
  "labels(c)[1] AS m, size(keys(c)) AS n, properties(c).name AS p, elementId(c) AS e",
  "SELECT c_custkey AS a, o_orderkey AS b, 'PLACED' AS t, 'Order' AS l, 'Party' AS m, 5::BIGINT AS n, "
  "c_name AS p, 'Customer:' || c_custkey AS e FROM customer JOIN orders ON o_custkey = c_custkey")
q("conversions",
  "MATCH (p:Part) RETURN p.partkey AS k, toInteger(p.retailprice) AS a, toFloat(p.size) AS b, "
  "toString(p.size) AS c, toBoolean(p.size % 2) AS d, to_int8(1) AS e, to_int16(p.size) AS f, "
  "to_int32(p.size) AS g, to_int64(p.size) AS h, to_uint8(p.size) AS i, to_uint16(p.size) AS j, "
  "to_uint32(p.size) AS l, to_float(p.size) AS m, string(p.size) AS n, tobool('false') AS o, "
  "to_bool('true') AS q, CAST(to_int128(p.size) AS INT64) AS r, CAST(to_uint64(p.size) AS INT64) AS s, "
  "CAST(to_uint128(p.size) AS INT64) AS t, typeof(p.name) AS u, typeof_matches(p.name, 'STRING') AS v",
  "SELECT p_partkey AS k, trunc(p_retailprice)::BIGINT AS a, p_size::DOUBLE AS b, p_size::VARCHAR AS c, "
  "p_size % 2 <> 0 AS d, 1::TINYINT AS e, p_size::SMALLINT AS f, p_size::INTEGER AS g, p_size::BIGINT AS h, "
  "p_size::SMALLINT AS i, p_size::INTEGER AS j, p_size::BIGINT AS l, p_size::FLOAT AS m, p_size::VARCHAR AS "
  "n, false AS o, true AS q, p_size::BIGINT AS r, p_size::BIGINT AS s, p_size::BIGINT AS t, 'STRING' AS u, "
  "true AS v FROM part")
q("temporal_constructors",
  "RETURN date('2021-03-04') AS a, date({year: 2020, month: 2}) AS b, localdatetime('2021-03-04T05:06:07') "
  "AS c, localtime('05:06:07') = ((5 * 60 + 6) * 60 + 7) * 1000000000 AS d, date.truncate('month', "
  "date('2021-03-14')) AS e, localdatetime.truncate('hour', localdatetime('2021-03-04T05:06:07')) AS f, "
  "datetime.fromepoch(60).minute AS g, datetime.fromepochmillis(61000).second AS h, "
  "toString(duration.inMonths(date('2020-01-15'), date('2021-03-14'))) AS i, "
  "duration.inSeconds(localdatetime('2020-01-01T00:00:00'), localdatetime('2020-01-01T01:30:00')).seconds "
  "AS j, toString(duration({hours: 30})) AS k, to_date('2020-05-06') AS l, date_diff('day', "
  "date('2020-01-01'), date('2020-02-01')) AS m, epoch_ms(0) AS n, "
  "to_epoch_ms(localdatetime('1970-01-01T00:00:01')) AS o, to_timestamp(90) AS p, "
  "monthname(date('2020-05-06')) AS q, toString(to_years(2)) AS r, toString(to_months(3)) AS s, "
  "toString(to_days(4)) AS t, toString(to_hours(5)) AS u, toString(to_seconds(6)) AS v, "
  "toString(to_milliseconds(1500)) AS w, toString(to_microseconds(2000000)) AS x, "
  "toString(duration('P1.5D')) AS y, toString(duration('PT2.5H')) AS z",
  "SELECT DATE '2021-03-04' AS a, DATE '2020-02-01' AS b, TIMESTAMP '2021-03-04 05:06:07' AS c, true AS d, "
  "DATE '2021-03-01' AS e, TIMESTAMP '2021-03-04 05:00:00' AS f, 1::BIGINT AS g, 1::BIGINT AS h, 'P1Y1M' AS "
  "i, 5400::BIGINT AS j, 'PT30H' AS k, DATE '2020-05-06' AS l, 31::BIGINT AS m, TIMESTAMP '1970-01-01 "
  "00:00:00' AS n, 1000::BIGINT AS o, TIMESTAMP '1970-01-01 00:01:30' AS p, 'May' AS q, 'P2Y' AS r, 'P3M' "
  "AS s, 'P4D' AS t, 'PT5H' AS u, 'PT6S' AS v, 'PT1.5S' AS w, 'PT2S' AS x, 'P1DT12H' AS y, 'PT2H30M' AS z")
q("json_paths",
  "MATCH (e:Event) RETURN e.event_id AS id, json.query(e.props, '$.k') AS q, json.query('[1,[2,3]]', "
  "'$..[0]') AS d, json.query('[5,6,7]', '$[-1]') AS n, json.query('[5,6,7]', '$[0:2]') AS s, "
  "json.query('{\"a\":1,\"b\":2}', '$[\"a\",\"b\"]') AS u, json.query('[{\"x\":1},{\"x\":5}]', '$[?(@.x > "
  "2)]') AS f, json.valid(e.props) AS v, json.keys(e.props)[0] AS k, json.equals('{\"a\":1}', '{ \"a\": 1 "
  "}') AS eq, json.contains('[1,2]', '[2]') AS c, size(json.elements('[1,2]')) AS el, "
  "json.entries('{\"a\":1}')[0].key AS en, json.parse('[1, 2]') AS p, json.insert('{}', '$.a', '1') AS i, "
  "json.replace('{\"a\":1}', '$.a', '2') AS r, json.object('a', 1) AS o, json.array(1, 2) AS a",
  "SELECT event_id AS id, '[' || json_extract_string(props, '$.k') || ']' AS q, '[1,2]' AS d, '[7]' AS n, "
  "'[5,6]' AS s, '[1,2]' AS u, '[{\"x\":5}]' AS f, true AS v, 'k' AS k, true AS eq, true AS c, 2::BIGINT AS "
  "el, 'a' AS en, '[1,2]' AS p, '{\"a\":1}' AS i, '{\"a\":2}' AS r, '{\"a\":1}' AS o, '[1,2]' AS a FROM "
  "events")
q("fn_math_more",
  "MATCH (p:Part) WITH DISTINCT p.size AS s RETURN s, fn.abs(-s) AS a, fn.ceil(s / 4.0) AS b, fn.floor(s / "
  "4.0) AS c, round(fn.sqrt(s), 9) AS d, round(fn.exp(s / 20.0), 6) AS e, round(fn.ln(s), 9) AS f, "
  "round(fn.log(s), 9) AS g, round(fn.log(2, s), 9) AS h, round(fn.log2(s), 9) AS i, round(fn.log10(s), 9) "
  "AS j, round(fn.power(s, 2), 3) AS k, round(fn.sin(s), 9) AS l, round(fn.cos(s), 9) AS m, round(fn.sinh(s "
  "/ 25.0), 8) AS n, round(fn.cosh(s / 25.0), 8) AS o, round(fn.asinh(s), 9) AS p, round(fn.acosh(s + 1), "
  "9) AS q, round(fn.atanh(s / 60.0), 9) AS r, fn.signum(s - 25) AS t, fn.gcd(s, 12) AS u, fn.factorial(s % "
  "10) AS v, fn.isnan(s / 1.0) AS w, fn.nanvl(s / 1.0, 1.0) AS x, round(fn.pi(), 6) AS y, "
  "round(fn.radians(s), 9) AS z",
  "SELECT s, s::BIGINT AS a, ceil(s / 4.0::DOUBLE) AS b, floor(s / 4.0::DOUBLE) AS c, round(sqrt(s), 9) AS "
  "d, round(exp(s / 20.0::DOUBLE), 6) AS e, round(ln(s), 9) AS f, round(log10(s), 9) AS g, round(ln(s) / "
  "ln(2), 9) AS h, round(log2(s), 9) AS i, round(log10(s), 9) AS j, round(pow(s, 2), 3) AS k, round(sin(s), "
  "9) AS l, round(cos(s), 9) AS m, round(sinh(s / 25.0::DOUBLE), 8) AS n, round(cosh(s / 25.0::DOUBLE), 8) "
  "AS o, round(asinh(s), 9) AS p, round(acosh(s + 1), 9) AS q, round(atanh(s / 60.0::DOUBLE), 9) AS r, "
  "sign(s - 25)::DOUBLE AS t, gcd(s, 12)::BIGINT AS u, factorial(s % 10)::BIGINT AS v, false AS w, "
  "s::DOUBLE AS x, round(pi(), 6) AS y, round(radians(s), 9) AS z FROM (SELECT DISTINCT p_size AS s FROM "
  "part)")
q("fn_strings_more",
  "MATCH (p:Part) RETURN p.partkey AS k, fn.btrim(' x ') AS a, fn.ltrim(' x') AS b, fn.rtrim('x ') AS c, "
  "fn.lower(p.name) AS d, fn.left(p.name, 3) AS e, fn.right(p.name, 3) AS f, fn.substr(p.name, 2, 3) AS g, "
  "fn.replace(p.brand, '#', '-') AS h, fn.reverse(p.name) AS i, fn.initcap('ab cd') AS j, fn.chr(65) AS l, "
  "fn.concat(p.brand, p.type) AS m, fn.concat_ws('_', p.brand, p.type) AS n, fn.starts_with(p.name, 'a') AS "
  "o, fn.ends_with(p.name, 'e') AS q, fn.contains(p.name, 'o') AS r, fn.levenshtein(p.brand, 'Brand#11') AS "
  "s, fn.lpad(p.brand, 10, '.') AS t, fn.to_hex(255) AS u, fn.character_length(p.name) AS v, "
  "fn.bit_length(p.name) AS w, fn.md5(p.name) AS x, fn.find_in_set('b', 'a,b') AS y, "
  "fn.substr_index('a.b.c', '.', 2) AS z",
  "SELECT p_partkey AS k, 'x' AS a, 'x' AS b, 'x' AS c, lower(p_name) AS d, left(p_name, 3) AS e, "
  "right(p_name, 3) AS f, substr(p_name, 2, 3) AS g, replace(p_brand, '#', '-') AS h, reverse(p_name) AS i, "
  "'Ab Cd' AS j, 'A' AS l, p_brand || p_type AS m, p_brand || '_' || p_type AS n, starts_with(p_name, 'a') "
  "AS o, ends_with(p_name, 'e') AS q, contains(p_name, 'o') AS r, levenshtein(p_brand, 'Brand#11')::INTEGER "
  "AS s, lpad(p_brand, 10, '.') AS t, 'ff' AS u, length(p_name) AS v, (strlen(p_name) * 8)::INTEGER AS w, "
  "md5(p_name) AS x, 2::INTEGER AS y, 'a.b' AS z FROM part")
q("fn_hash_regex",
  "MATCH (p:Part) RETURN p.partkey AS k, fn.sha256(p.name) AS a, length(fn.sha224(p.name)) AS b, "
  "length(fn.sha384(p.name)) AS c, length(fn.sha512(p.name)) AS d, fn.regexp_like(p.brand, '#[0-9]') AS e, "
  "fn.regexp_count(p.name, '[aeiou]') AS f, fn.regexp_instr(p.brand, '#') AS g, fn.regexp_replace(p.brand, "
  "'#', '@') AS h, size(fn.regexp_match(p.brand, '[0-9]')) AS i, size(fn.string_to_array(p.type, ' ')) AS "
  "j, fn.overlay('abcdef', 'ZZ', 3) AS l, lower(fn.to_hex(octet_length(fn.digest(p.name, 'sha256')))) AS m",
  "SELECT p_partkey AS k, sha256(p_name) AS a, 56::BIGINT AS b, 96::BIGINT AS c, 128::BIGINT AS d, "
  "regexp_matches(p_brand, '#[0-9]') AS e, len(regexp_extract_all(p_name, '[aeiou]'))::INTEGER AS f, "
  "instr(p_brand, '#')::INTEGER AS g, replace(p_brand, '#', '@') AS h, len(regexp_extract_all(p_brand, "
  "'[0-9]')) AS i, len(string_split(p_type, ' ')) AS j, 'abZZef' AS l, '20' AS m FROM part")
q("fn_arrays_more",
  "MATCH (p:Part) WITH DISTINCT p.size AS s WITH s, [s, 3, 3, 9] AS xs RETURN s, fn.array_append(xs, 1)[4] "
  "AS a, fn.array_prepend(1, xs)[0] AS b, fn.array_concat(xs, [2])[4] AS c, fn.array_has(xs, 9) AS d, "
  "fn.array_has_all(xs, [3, 9]) AS e, fn.array_length(xs) AS f, fn.array_max(xs) AS g, "
  "fn.array_pop_back(xs)[2] AS h, fn.array_pop_front(xs)[0] AS i, size(fn.array_positions(xs, 3)) >= 2 AS "
  "j, size(fn.array_remove([3, 1, 3], 3)) AS k, size(fn.array_remove_n([3, 1, 3, 3], 3, 2)) AS l, "
  "fn.array_replace([3, 1, 3], 3, 7)[2] AS m, fn.array_replace_n([3, 1, 3], 3, 7, 2)[2] AS n, "
  "fn.array_replace_all([3, 1, 3], 3, 7)[0] AS o, size(fn.array_resize(xs, 6, 0)) AS p, "
  "size(fn.array_resize(xs, 2)) AS q, fn.array_slice(xs, 2, 3)[0] AS r, fn.array_sort(xs)[3] AS t, "
  "size(fn.array_intersect(xs, [3])) AS u, fn.array_ndims([[1], [2]]) AS v, fn.array_dims([[1, 2]])[1] AS "
  "w, fn.range(1, 3)[1] AS x, fn.make_array(s, 2)[1] AS y, fn.empty([]) AS z",
  "SELECT s, 1::BIGINT AS a, 1::BIGINT AS b, 2::BIGINT AS c, true AS d, true AS e, 4::BIGINT AS f, "
  "greatest(s, 9)::BIGINT AS g, 3::BIGINT AS h, 3::BIGINT AS i, true AS j, 2::BIGINT AS k, 2::BIGINT AS l, "
  "3::BIGINT AS m, 7::BIGINT AS n, 7::BIGINT AS o, 6::BIGINT AS p, 2::BIGINT AS q, 3::BIGINT AS r, "
  "greatest(s, 9)::BIGINT AS t, 1::BIGINT AS u, 2::BIGINT AS v, 2::BIGINT AS w, 2::BIGINT AS x, 2::BIGINT "
  "AS y, true AS z FROM (SELECT DISTINCT p_size AS s FROM part)")
q("fn_times_more",
  "MATCH (o:Order) RETURN o.orderkey AS k, fn.date_trunc('year', o.orderdate) AS a, fn.date_part('month', "
  "o.orderdate) AS b, fn.to_date('2020-01-02') AS c, fn.make_date(2020, 1, 2) AS d, fn.make_time(4, 5, 6) "
  "AS e, fn.to_time('04:05:06') AS f, fn.to_timestamp('2020-01-02 03:04:05') AS g, "
  "fn.to_local_time('2020-01-02T03:04:05') AS h, fn.to_timestamp_seconds(60) AS i, "
  "fn.to_timestamp_millis(61000) AS j, fn.to_timestamp_micros(62000000) AS l, "
  "fn.to_timestamp_nanos(63000000000) AS m, fn.from_unixtime(64) AS n, fn.date_bin(duration('P1D'), "
  "o.orderdate) AS q, fn.current_date() = current_date() AS r, size(fn.current_time()) AS s",
  "SELECT o_orderkey AS k, date_trunc('year', o_orderdate)::TIMESTAMP AS a, month(o_orderdate) AS b, DATE "
  "'2020-01-02' AS c, DATE '2020-01-02' AS d, '04:05:06' AS e, '04:05:06.000000' AS f, TIMESTAMP "
  "'2020-01-02 03:04:05' AS g, TIMESTAMP '2020-01-02 03:04:05' AS h, TIMESTAMP '1970-01-01 00:01:00' AS i, "
  "TIMESTAMP '1970-01-01 00:01:01' AS j, TIMESTAMP '1970-01-01 00:01:02' AS l, TIMESTAMP '1970-01-01 "
  "00:01:03' AS m, TIMESTAMP '1970-01-01 00:01:04' AS n, date_trunc('day', o_orderdate)::TIMESTAMP AS q, "
  "true AS r, 15::BIGINT AS s FROM orders")
q("fn_structs",
  "MATCH (p:Part) WITH DISTINCT p.size AS s RETURN s, fn.named_struct('a', s).a AS a, fn.struct(s, 1).c1 AS "
  "b, fn.map(['k'], [s])['k'] AS c, fn.map_keys(map(['k'], [s]))[0] AS d, fn.map_values(map(['k'], [s]))[0] "
  "AS e, fn.map_extract(map(['k'], [s]), 'k')[0] AS f, fn.get_field({z: s}, 'z') AS g, "
  "fn.union_tag(union_value('t', s)) AS h, fn.arrow_typeof(1) AS i, fn.arrow_cast('3', 'INT64') AS j, "
  "fn.version() IS NOT NULL AS k",
  "SELECT s, s AS a, 1::BIGINT AS b, s AS c, 'k' AS d, s AS e, s AS f, s AS g, 't' AS h, 'INT64' AS i, "
  "3::BIGINT AS j, true AS k FROM (SELECT DISTINCT p_size::BIGINT AS s FROM part)")


# --- writes ---------------------------------------------------------------------------------
def _store(spark: SparkSession) -> Store:
    """A scratch graph in the shared checkpoint folder."""
    g = Graph(spark, from_dict({}))
    g.settle(spark.range(1))
    return Store(spark, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/graph-{uuid.uuid4().hex}")


def _written(*statements: str, read: str, **params: Any):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = _store(spark)
        for text in statements:
            s.cypher(text, **params)
        return s.cypher(read)

    return run


ITEMS = "UNWIND range(0, 199) AS i CREATE (:Item {i: i, sq: i * i})"
q("write_create", _written(ITEMS, "MATCH (a:Item), (b:Item) WHERE b.i = a.i + 1 CREATE (a)-[:NEXT {gap: b.sq - a.sq}]->(b)", read="MATCH (a:Item)-[r:NEXT]->(b) RETURN a.i AS a, b.i AS b, r.gap AS g"),
  "SELECT range AS a, range + 1 AS b, 2 * range + 1 AS g FROM range(0, 199)")
q("write_label_sets", _written("UNWIND range(0, 9) AS i CREATE (:A {i: i}), (:A:B {i: i + 100}), (:B {i: i + 200})", read="MATCH (n:A) RETURN n.i AS i, size(labels(n)) AS l"),
  "SELECT range AS i, 1::BIGINT AS l FROM range(0, 10) UNION ALL SELECT range + 100, 2 FROM range(0, 10)")
q("write_set_remove", _written(ITEMS, "MATCH (n:Item) WHERE n.i % 2 = 0 SET n.even = true, n.sq = -n.sq", "MATCH (n:Item) WHERE n.i % 4 = 0 REMOVE n.even", "MATCH (n:Item) WHERE n.i % 10 = 0 SET n += {tag: 'ten'}", read="MATCH (n:Item) RETURN n.i AS i, n.sq AS s, n.even AS e, n.tag AS t"),
  "SELECT range AS i, CASE WHEN range % 2 = 0 THEN -range * range ELSE range * range END AS s, CASE WHEN "
  "range % 2 = 0 AND range % 4 <> 0 THEN true END AS e, CASE WHEN range % 10 = 0 THEN 'ten' END AS t FROM "
  "range(0, 200)")
q("write_relabel", _written(ITEMS, "MATCH (n:Item) WHERE n.i < 50 SET n:Low", "MATCH (n:Low) WHERE n.i < 20 REMOVE n:Item", read="MATCH (n) RETURN list_join(labels(n), '+') AS l, count(*) AS n"),
  "SELECT * FROM (VALUES ('Item', 150::BIGINT), ('Item+Low', 30), ('Low', 20)) v(l, n)")
q("write_merge", _written("UNWIND range(0, 99) AS i MERGE (n:Key {k: i % 7}) ON CREATE SET n.made = true", "UNWIND [3, 4, 50] AS i MERGE (n:Key {k: i}) ON CREATE SET n.late = true ON MATCH SET n.seen = true", read="MATCH (n:Key) RETURN n.k AS k, n.made AS m, n.late AS l, n.seen AS s"),
  "SELECT range AS k, true AS m, NULL::BOOLEAN AS l, CASE WHEN range IN (3, 4) THEN true END AS s FROM "
  "range(0, 7) UNION ALL SELECT 50, NULL, true, NULL")
q("write_delete", _written(ITEMS, "MATCH (a:Item), (b:Item) WHERE b.i = a.i + 1 CREATE (a)-[:NEXT]->(b)", "MATCH (n:Item) WHERE n.i % 3 = 0 DETACH DELETE n", "MATCH (:Item {i: 1})-[r:NEXT]->() DELETE r", read="MATCH (n:Item) RETURN n.i AS i, COUNT { (n)-[:NEXT]->() } AS out"),
  "SELECT range AS i, (CASE WHEN range % 3 = 1 AND range <> 1 AND range + 1 < 200 THEN 1 ELSE 0 "
  "END)::BIGINT AS out FROM range(0, 200) WHERE range % 3 <> 0")


def _transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark)
    s.cypher(ITEMS)
    s.begin()
    s.cypher("MATCH (n:Item) DETACH DELETE n")
    s.rollback()
    s.begin()
    s.cypher("UNWIND [1000, 1001] AS i CREATE (:Item {i: i})")
    s.commit()
    return s.cypher("MATCH (n:Item) RETURN count(*) AS n, max(n.i) AS top").withColumn("revision", F.lit(s.revision).cast("long"))


q("write_transactions", _transaction, "SELECT 202::BIGINT AS n, 1001::BIGINT AS top, 2::BIGINT AS revision")


# --- change records, streams, policies ------------------------------------------------------
def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change log: one key a user, one version an event, tombstones for errors."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    data = F.when(F.col("event_type") != "error", F.to_json(F.struct("event_id", "event_type", "value")))
    return e.select(F.lit(0).alias("partition"), F.col("event_id").alias("offset"), F.lit("events").alias("table"), F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("version"), data.alias("data"))


q("change_latest", lambda spark, d: changes.latest(_log(spark, d)).select("key", "version"),
  "SELECT user_id::VARCHAR AS key, max(event_id) AS version FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'")


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    low, high = log.agg(F.min("offset"), F.max("offset")).first()
    half = (low + high + 1) // 2
    base = changes.snapshot(log, {0: low}, {0: half})
    return changes.snapshot(log, {0: half}, {0: high + 1}, base).select("key", "version", F.col("data").isNull().alias("gone"))


q("change_snapshot_and_replay", _snapshots,
  "SELECT user_id::VARCHAR AS key, max(event_id) AS version, arg_max(event_type, event_id) = 'error' AS "
  "gone FROM events GROUP BY 1")


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
    return changes.decoded(changes.latest(_log(spark, sf_dir)), "events", schema)


q("change_decoded", _decoded,
  "SELECT user_id::VARCHAR AS key, max(event_id) AS version, arg_max(event_type, event_id) AS event_type, "
  "arg_max(value, event_id) AS value FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'")
q("event_windows", lambda spark, d: changes.windowed(spark.read.parquet(f"{d}/events.parquet"), "1 day").select("start", "event_type", "n", F.round("total", 4).alias("total")),
  "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
q("event_windows_sliding", lambda spark, d: changes.windowed(spark.read.parquet(f"{d}/events.parquet"), "2 days", "1 day").groupBy("event_type").agg(F.sum("n").alias("n")),
  "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY 1")
q("event_sessions", lambda spark, d: changes.sessions(spark.read.parquet(f"{d}/events.parquet"), "12 hours").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n")),
  "SELECT user_id, sum(new)::BIGINT AS sessions, count(*) AS n FROM (SELECT user_id, CASE WHEN ts < lag(ts) "
  "OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER "
  "BY ts)) GROUP BY 1")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, aggregated by event time and written out once the stream has ended."""
    where = f"{_store(spark).path}-stream"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: the table may be one file
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    counts = events.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"]).groupBy("event_type").agg(F.count("*").alias("n"))
    name = f"counts_{uuid.uuid4().hex}"
    run = counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", where).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


q("stream_counts", _streamed, "SELECT event_type, count(*) AS n FROM events GROUP BY 1")


def _secured(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def decide(action: str, resource: dict[str, Any]) -> Any:
            if action == "GetRowFilters":
                return ["c_acctbal > 0"] if resource["table"] == "customer" else None
            if action == "GetColumnMasks":
                return {"c_name": "concat(left(c_name, 3), '***')"} if resource["table"] == "customer" else None
            return True

        granted = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_nationkey < 10").select(
            F.lit("customer").alias("resource_type"), F.lit("view").alias("resource_rel"), F.col("c_custkey").cast("string").alias("resource_id"),
            F.lit("user").alias("subject_type"), F.lit("").alias("subject_rel"), F.lit("ann").alias("subject_id"),
        )
        scopes = {"customer": {"resource_type": "customer", "relation": "view", "column": "c_custkey"}}
        return graph(spark, sf_dir, policy=Policy(decide, granted, scopes, ("user", "ann"))).cypher(text)

    return run


q("policy_rows_and_masks", _secured("MATCH (c:Customer) RETURN c.custkey AS k, c.name AS name"), "SELECT c_custkey AS k, left(c_name, 3) || '***' AS name FROM customer WHERE c_acctbal > 0 AND c_nationkey < 10")
q("policy_before_joins", _secured("MATCH (c:Customer)-[:PLACED]->(o) WHERE c.name STARTS WITH 'Cus' RETURN count(*) AS n"),
  "SELECT count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0 AND "
  "c_nationkey < 10")


def _two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k in two stages: candidates by one vector, ranked again by another."""
    from .sources.mapping import ComputedMapping

    close = ComputedMapping("CLOSE", "Vector", "Vector", "top_k", {"first": ["embedding", "embedding"], "candidates": 20, "vector": ["embedding", "embedding"], "k": 2, "measure": "l2", "where": "a.vec_id % 20 = 0"})
    return graph(spark, sf_dir).extended(close).cypher("MATCH (a:Vector)-[s:CLOSE]->(b:Vector) RETURN a.vec_id AS a, b.vec_id AS b, s.rank AS r")


q("two_stage_top_k", _two_stage,
  "SELECT a, b, r::INTEGER AS r FROM (SELECT a.vec_id AS a, b.vec_id AS b, row_number() OVER (PARTITION BY "
  "a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS r FROM "
  "embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE r <= 2")


def _procedure(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    g.register("half", lambda x: x / 2)
    g.register_procedure("parts_of", lambda brand: spark.read.parquet(f"{sf_dir}/part.parquet").where(F.col("p_brand") == brand).selectExpr("p_partkey AS k", "p_size AS s"))
    return g.cypher("CALL parts_of($b) YIELD k, s RETURN k, half(s) AS h", b="Brand#11")


q("procedure_and_function", _procedure, "SELECT p_partkey AS k, p_size / 2.0::DOUBLE AS h FROM part WHERE p_brand = 'Brand#11'")


# --- sources, catalog, declared functions ---------------------------------------------------
PARTS_OF = {
    "nodes": [
        {"label": "Vector", "table": "embeddings", "key": "vec_id", "properties": {"vec_id": "vec_id"}},
        {"label": "Part", "table": "embeddings", "key": ["vec_id", "at"], "properties": {"at": "at", "value": "value"}, "collection": {"column": "embedding", "as": "value", "ordinality": "at"}},
        {"label": "Field", "table": "events", "key": ["event_id", "field"], "properties": {"event_id": "event_id", "field": "field"}, "collection": {"expr": "json_object_keys(props)", "as": "field", "outer": True}},
    ],
    "edges": [{"type": "HAS", "table": "embeddings", "source": "Vector", "target": "Part", "source_key": "vec_id", "target_key": ["vec_id", "at"], "id": ["vec_id", "at"], "collection": {"column": "embedding", "as": "value", "ordinality": "at"}}],
}


def _parts(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = {t: (lambda t=t: spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in ("embeddings", "events")}
        return Graph(spark, from_dict(PARTS_OF), tables).cypher(text)

    return run


q("collection_ordinality", _parts("MATCH (v:Vector)-[:HAS]->(p:Part) RETURN v.vec_id AS v, p.at AS i, p.value AS x"),
  "SELECT vec_id AS v, (i - 1)::INTEGER AS i, embedding[i] AS x FROM embeddings, range(1, 65) r(i) WHERE i <= len(embedding)")
q("collection_of_json", _parts("MATCH (f:Field) RETURN f.field AS f, count(*) AS n"), "SELECT unnest(json_keys(props)) AS f, count(*) AS n FROM events GROUP BY 1")


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables by their names in the session's catalog."""
    name = f"parts_{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView(name)
    doc = {"nodes": [{"label": "Part", "table": name, "key": "p_partkey", "properties": {"size": "p_size"}}]}
    return Graph(spark, from_dict(doc)).cypher("MATCH (p:Part) RETURN p.size AS s, count(*) AS n")


q("registered_view", _views, "SELECT p_size AS s, count(*) AS n FROM part GROUP BY 1")


def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir).declare("agg.spread", lambda x: F.max(x) - F.min(x), ["int64"], "int64", aggregate=True)
    g.declare("plus_tax", lambda x, t: x * (1 + t), ["float64", "float64"], "float64")
    return g.cypher("MATCH (p:Part) RETURN p.brand AS b, agg.spread(p.size) AS s, round(sum(plus_tax(p.retailprice, '0.5')), 2) AS t")


q("declared_functions", _declared,
  "SELECT p_brand AS b, (max(p_size) - min(p_size))::BIGINT AS s, round(sum(p_retailprice * 1.5::DOUBLE), "
  "2) AS t FROM part GROUP BY 1")
q("statistics", lambda spark, d: graph(spark, d).statistics().where("kind = 'node' AND table IN ('customer', 'part', 'orders', 'nation') AND name <> 'BigOrder'").select("name", "rows"),
  "SELECT 'Customer' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'Part', count(*) FROM part "
  "UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Nation', count(*) FROM nation")
q("explain", lambda spark, d: graph(spark, d).cypher("EXPLAIN MATCH (p:Part) WHERE p.size > 40 RETURN p.name").select(F.contains("plan", F.lit("Scan parquet")).alias("scan"), F.contains("plan", F.lit("GreaterThan(p_size,40)")).alias("pushed")),
  "SELECT true AS scan, true AS pushed")


def _cataloged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relationship registered in a catalog, used, and gone again in a later revision."""
    from .catalog import Catalog
    from .demo import MAPPING, TABLES
    from .sources.mapping import ComputedMapping

    tables = {t: (lambda t=t: spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in TABLES}
    c = Catalog(spark, from_dict(MAPPING), tables)
    same = ComputedMapping("SAME_NATION", "Customer", "Supplier", "cypher", {"query":
  "MATCH (c:Customer)-[:FROM_NATION]->(n)<-[:FROM_NATION]-(s:Supplier) RETURN c.custkey AS source, "
  "s.suppkey AS target"})
    seen = c.register(same, 0)
    c.remove("SAME_NATION", seen.revision)
    return c.graph(seen).cypher("MATCH (c:Customer)-[:SAME_NATION]->(s:Supplier) RETURN s.suppkey AS s, count(*) AS n")


q("catalog_revisions", _cataloged, "SELECT s_suppkey AS s, count(*) AS n FROM supplier JOIN customer ON c_nationkey = s_nationkey GROUP BY 1")


def _subscribed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Cypher subscription over a change log: the frames it sends, the last one of each key."""
    from pyspark.sql import types as T

    fields = [T.StructField("id", T.StringType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())]
    doc = {"nodes": [{"label": "User", "table": "events", "key": "id", "properties": {"id": "id", "kind": "event_type", "value": "value"}}]}
    g = Graph(spark, from_dict(doc), {"events": spark.createDataFrame([], T.StructType(fields))})
    where = _store(spark).path
    _log(spark, sf_dir).write.parquet(f"{where}-log")
    stream = spark.readStream.schema(changes.SCHEMA).parquet(f"{where}-log")
    sink = lambda df, n: df.write.mode("overwrite").parquet(f"{where}-frames/n={n}")
    text = "MATCH (u:User) WHERE u.value > 50 RETURN u.kind AS kind, u.value * 2 AS twice"
    changes.subscribe_query(g, text, stream, "events", T.StructType(fields), sink, f"{where}-cp", f"{where}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{where}-frames").groupBy("key").agg(F.max_by(F.struct("version", "deleted", "kind", "twice"), "n").alias("r")).select("key", "r.*")


q("stream_subscription", _subscribed,
  "WITH l AS (SELECT user_id::VARCHAR AS key, max(event_id) AS version, arg_max(event_type, event_id) AS k, "
  "arg_max(value, event_id) AS v FROM events GROUP BY 1) SELECT key, version, NOT (k <> 'error' AND v > 50) "
  "AS deleted, CASE WHEN k <> 'error' AND v > 50 THEN k END AS kind, CASE WHEN k <> 'error' AND v > 50 THEN "
  "v * 2 END AS twice FROM l")


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as edges of a log: valid and allowed as a whole, and seen where both ends are live."""
    from pyspark.sql import types as T

    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    row = lambda table, key, data: [F.lit(0).alias("partition"), key.cast("long").alias("offset"), F.lit(table).alias("table"), key.cast("string").alias("key"), F.lit(1).cast("long").alias("version"), data.alias("data")]
    alive = F.when(F.col("c_acctbal") >= 0, F.to_json(F.struct(F.col("c_acctbal").alias("balance"))))
    log = c.select(row("customer", F.col("c_custkey"), alive)).unionByName(o.select(row("order", F.col("o_orderkey"), F.to_json(F.struct(F.col("o_custkey").alias("by"), F.col("o_custkey").alias("of"))))))
    rules = {
        "customer": changes.Rule(T.StructType([T.StructField("balance", T.DoubleType())]), ("balance",), "see", "write"),
        "order": changes.Rule(T.StructType([T.StructField("by", T.LongType()), T.StructField("of", T.LongType())]), ("by",), "see", "write", ("customer", "by", "customer", "of")),
    }
    log = changes.authorized(changes.validated(log, rules), rules, lambda p: True)
    return changes.visible(changes.latest(log, tombstones=True), rules).groupBy("table").agg(F.count("*").alias("n"))


q("change_checks", _checked,
  "SELECT 'customer' AS \"table\", count(*) AS n FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT "
  "'order', count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 0")
