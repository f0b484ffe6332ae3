"""Tables from other stores, as functions that a `Graph` opens when a query needs them.

Parquet, CSV, JSON and JDBC come with Spark. Iceberg, Delta and Kafka need their Spark packages; where
one is not installed, opening the table raises `UnsupportedFault`.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UnsupportedFault

Opener = Callable[[], DataFrame]


def files(spark: SparkSession, kind: str, path: str, schema: Any = None, **options: Any) -> Opener:
    """`kind` is parquet, csv, json, orc, text or xml."""

    def open_() -> DataFrame:
        reader = spark.read.format(kind).options(**options)
        return (reader.schema(schema) if schema is not None else reader).load(path)

    return open_


def jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 1, **options: Any) -> Opener:
    """A table or query of a database; with `column` and `bounds` it is read in `parts` ranges at once."""

    def open_() -> DataFrame:
        reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
        if column is not None and bounds is not None:
            reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
        return _loaded(reader.load, "jdbc")

    return open_


def iceberg(spark: SparkSession, name: str, snapshot: int | None = None, timestamp_ms: int | None = None) -> Opener:
    """An Iceberg table, as it is or at a snapshot or time."""
    options = {"snapshot-id": snapshot, "as-of-timestamp": timestamp_ms}
    chosen = {k: str(v) for k, v in options.items() if v is not None}
    return lambda: _loaded(lambda: spark.read.format("iceberg").options(**chosen).load(name), "iceberg")


def delta(spark: SparkSession, path: str, version: int | None = None, timestamp: str | None = None) -> Opener:
    """A Delta table, as it is or at a version or time."""
    options = {"versionAsOf": version, "timestampAsOf": timestamp}
    chosen = {k: str(v) for k, v in options.items() if v is not None}
    return lambda: _loaded(lambda: spark.read.format("delta").options(**chosen).load(path), "delta")


def kafka(spark: SparkSession, servers: str, topic: str, start: str = "earliest", end: str = "latest") -> Opener:
    """The change records of a topic between two offsets (JSON as Kafka's source takes them)."""

    def open_() -> DataFrame:
        reader = spark.read.format("kafka").options(**{"kafka.bootstrap.servers": servers}, subscribe=topic, startingOffsets=start, endingOffsets=end, failOnDataLoss="true")
        raw = _loaded(reader.load, "kafka")
        body = F.from_json(F.col("value").cast("string"), "`table` string, version long, data string")
        return raw.select("partition", "offset", F.col("key").cast("string").alias("key"), body.alias("b")).select("partition", "offset", "b.table", "key", "b.version", "b.data")

    return open_


def _loaded(load: Callable[[], DataFrame], kind: str) -> DataFrame:
    try:
        return load()
    except Exception as e:
        if "DATA_SOURCE_NOT_FOUND" in str(e) or "Failed to find data source" in str(e) or "ClassNotFoundException" in str(e) or "No suitable driver" in str(e):
            raise UnsupportedFault(f"the Spark package or driver of {kind} is not installed") from e
        raise
