"""Contiguous shards of near-equal bytes from global prefix sums (DataFrame functions only).

`assign` orders rows by key and cuts the running byte sum at equal targets. The order is made by
one range partitioning of (key, size, checksum) triples: the texts themselves never move. Per-
partition totals, a table of one row per partition, give every partition its global offset; a
window inside each partition does the rest, so no task ever holds more than its own range; a row
repeated in a third of the table is spread over ranges like any other.

Defined edge cases: a null text has size 1 and the checksum of the empty string; an empty table
gives an empty result; rows repeated under one key keep one slot each, in the order of checksum
and size; further input columns are ignored, whatever their names; null keys come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ready, saved, table

SHARDS = 8


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, size, text_crc32, shard, slot.

    `shard` is non-decreasing in `key`; each shard's bytes differ from total/shards by less than
    one row's size; `slot` counts from 0 within a shard without gaps.
    """
    ready(docs.sparkSession)
    rows = docs.select(
        F.col(key).alias("_k"), text_size(F.col(text)).alias("_size"), text_crc32(F.col(text)).alias("_crc"),
        F.monotonically_increasing_id().alias("_n"),  # lets rows that repeat lie in several ranges
    )
    # a stored copy fixes which row lies in which partition, whatever is recomputed later
    placed = saved(rows.repartitionByRange("_k", "_crc", "_size", "_n").withColumn("_p", F.spark_partition_id()))
    totals = placed.groupBy("_p").agg(F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select(
        "_p",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_b0"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_r0"),
        F.sum("_bytes").over(Window.partitionBy(F.lit(0))).alias("_all"),
    )
    within = Window.partitionBy("_p").orderBy("_k", "_crc", "_size", "_n")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    numbered = (
        placed.withColumn("_in", F.sum("_size").over(upto))
        .withColumn("_rn", F.row_number().over(within))
        .join(F.broadcast(offsets), "_p")  # as many rows as partitions
        .withColumn("_at", F.col("_r0") + F.col("_rn") - 1)
        # a row belongs to the target interval that holds its middle byte
        .withColumn(
            "shard",
            F.least(
                F.lit(shards - 1).cast("long"),
                F.expr(f"(2 * (_b0 + _in) - _size) * {int(shards)} div (2 * _all)"),
            ).cast("int"),
        )
    )
    first = numbered.groupBy("shard").agg(F.min("_at").alias("_first"))
    return numbered.join(F.broadcast(first), "shard").select(  # one row per shard
        F.col("_k").alias(key),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        "shard",
        (F.col("_at") - F.col("_first")).cast("long").alias("slot"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law `bytes`."""
    out = assign(table(ready(spark), sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
