"""Breadth-first shortest paths over an edge table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shortest(
    seeds: DataFrame, wanted: DataFrame, edges: DataFrame | None, low: int, high: int | None, all_paths: bool,
    settle: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """(`_s`, `_e`, `_path`, `_nodes`) of the shortest paths of `low` to `high` steps from seeds `_s` to wanted ends.

    `wanted` has the pairs (`_s`, `_e`), or `_e` alone where every seed wants every end; `edges` has
    `_a`, `_b`, `_step` and `_node` (what `_nodes` lists of the far end). A frontier grows one hop a
    round; a seed whose ends are all reached leaves it, and the search is over when no seed is left
    or nothing grows. There is no other bound on the length.

    Up to a lower bound of 1 an end keeps its least distance only: paths that come back to a node met
    before are longer than some other. Beyond, all trails are grown until their ends are reached.
    Paths from a node to itself are found for a lower bound of 0, and from 2 on.

    The driver is asked once a round whether the frontier is empty; nothing else comes to it.
    """
    pairs = "_s" in wanted.columns
    wanted = settle(wanted)
    step = edges.schema["_step"].dataType.simpleString() if edges is not None else "struct<_id:string>"
    node = edges.schema["_node"].dataType.simpleString() if edges is not None else "struct<_key:string>"
    frontier = settle(seeds.select("_s", F.col("_s").alias("_e"), F.array().cast(f"array<{step}>").alias("_path"), F.array().cast(f"array<{node}>").alias("_nodes")).distinct())
    asked = wanted.groupBy("_s").agg(F.count("*").alias("_n")) if pairs else seeds.select("_s").distinct().crossJoin(F.broadcast(wanted.agg(F.count("*").alias("_n"))))
    asked = settle(asked)
    reached = frontier.select("_s", "_e")
    keys = ["_s", "_e"] if pairs else ["_e"]
    out = settle(frontier.join(wanted, keys, "left_semi")) if low == 0 else frontier.where("false")
    hits, length = [out], 0
    if edges is not None:
        edges = settle(edges)
    while edges is not None and (high is None or length < high):
        length += 1
        grown = frontier.join(edges, F.col("_e") == F.col("_a"))
        if low > 1:
            grown = grown.where(~F.exists("_path", lambda x: (x["_type"] == F.col("_step")["_type"]) & (x["_id"] == F.col("_step")["_id"])))
        grown = grown.select("_s", F.col("_b").alias("_e"), F.array_append("_path", F.col("_step")).alias("_path"), F.array_append("_nodes", F.col("_node")).alias("_nodes"))
        if low <= 1:
            grown = grown.join(reached, ["_s", "_e"], "left_anti")
            if not all_paths:
                grown = grown.groupBy("_s", "_e").agg(F.min(F.struct("_path", "_nodes")).alias("_p")).select("_s", "_e", "_p.*")
        frontier = settle(grown)
        if frontier.isEmpty():
            break
        if length >= low:
            # ends that an earlier round reached are not hit again
            hit = frontier.join(wanted, keys, "left_semi")
            for earlier in hits if low > 1 else ():
                hit = hit.join(earlier, ["_s", "_e"], "left_anti")
            if low > 1 and not all_paths:
                hit = hit.groupBy("_s", "_e").agg(F.min(F.struct("_path", "_nodes")).alias("_p")).select("_s", "_e", "_p.*")
            if low <= 1 and hit.isEmpty():
                reached = reached.unionByName(frontier.select("_s", "_e"))
                reached = settle(reached) if length % 10 == 0 else reached  # keeps the plan short on long chains
                continue
            hit = settle(hit)
            hits.append(hit)
            out = out.unionByName(hit)
            done = out.select("_s", "_e").distinct().groupBy("_s").agg(F.count("*").alias("_m"))
            left = asked.join(done, "_s", "left").where(F.coalesce("_m", F.lit(0)) < F.col("_n")).select("_s")
            frontier = frontier.join(left, "_s", "left_semi")
        if low <= 1:
            reached = reached.unionByName(frontier.select("_s", "_e").distinct())
            if length % 10 == 0:
                reached, out = settle(reached), settle(out)
    return out
