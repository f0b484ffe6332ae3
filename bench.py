"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores (default
8), BENCH_ROUNDS the runs of each query (default 3; the median counts). A first run of every query
warms the JVM up and is not counted.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from loomgraph import queries
from loomgraph.demo import graph

#: The published baseline's query shapes over the star schema, then larger joins and aggregates.
EXTRA = {
    "node_count": "MATCH (o:Order) RETURN count(*) AS n",
    "filter_count": "MATCH (o:Order) WHERE o.totalprice > 200000 RETURN count(*) AS n",
    "out_count": "MATCH (c:Customer)-[:PLACED]->(o) RETURN count(*) AS n",
    "property_sum": "MATCH (o:Order) RETURN sum(o.totalprice) AS s",
    "filter_order": "MATCH (p:Part) WHERE p.size > 40 RETURN p.retailprice AS p ORDER BY p",
    "local_count_sum": "MATCH (c:Customer) RETURN sum(COUNT { (c)-[:PLACED]->() }) AS s",
    "group_count": "MATCH (l:Order)-[r:CONTAINS]->() RETURN r.quantity AS q, count(*) AS n",
    "count_distinct": "MATCH (:Order)-[r:CONTAINS]->() RETURN count(DISTINCT r.extendedprice) AS n",
    "upper_trim": "MATCH (p:Part) RETURN max(trim(toUpper(p.name))) AS m",
    "join_aggregate": "MATCH (c:Customer)-[:PLACED]->(o)-[r:CONTAINS]->(p:Part) RETURN p.brand AS b, "
                      "sum(r.quantity) AS q",
}
NAMED = [
    "segment_totals", "three_hop", "two_hop_unique", "optional_match", "exists_subquery", "varlen_bounded", "as_of",
    "collect_ordered", "agg_percentile", "theta_relationship",
]
TABLES = ("orders", "lineitem", "customer", "part", "nation", "events")
#: The largest table that a query reads, for rows a second.
READS = {
    "node_count": "orders", "filter_count": "orders", "out_count": "orders", "property_sum": "orders", "filter_order": "part",
    "local_count_sum": "orders", "group_count": "lineitem", "count_distinct": "lineitem", "upper_trim": "part",
    "join_aggregate": "lineitem", "segment_totals": "orders", "three_hop": "customer", "two_hop_unique": "nation",
    "optional_match": "orders", "exists_subquery": "orders", "varlen_bounded": "nation", "as_of": "orders",
    "collect_ordered": "nation", "agg_percentile": "part", "theta_relationship": "part",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, rounds = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_ROUNDS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    g = graph(spark, sf_dir)
    runs = {n: (lambda t=t: g.cypher(t)) for n, t in EXTRA.items()}
    runs |= {n: (lambda n=n: g.cypher(queries.QUERIES[n][0], **queries.QUERIES[n][1])) for n in NAMED}
    counts = {t: g.table(t).count() for t in TABLES}
    times, rates = {}, {}
    for name, build in runs.items():
        build().write.format("noop").mode("overwrite").save()
        taken = []
        for _ in range(rounds):
            began = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        times[name] = round(statistics.median(taken), 4)
        rates[name] = round(counts[READS[name]] / times[name])
    line = {
        "metric": "headline queries, median of all runs summed", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "rows_per_sec": rates, "sf": os.path.basename(sf_dir.rstrip("/")),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
