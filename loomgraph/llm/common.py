"""Shared helpers: table access, checkpoint folder, worker path, bounded Arrow batches."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch handed to Python: bounds a worker's memory for long texts.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` below `sf_dir`, read by Spark (any store it can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Make the session fit for these operators and return it.

    The checkpoint folder is the session's own (`spark.checkpoint.dir`); one is set here only
    where none is configured and the master is local, as in tests.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = sc.getConf().get("spark.checkpoint.dir", None)
        if where is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="loomgraph-checkpoint-")
        sc.setCheckpointDir(where)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = sc.environment.get("PYTHONPATH", "")
    if root not in path.split(":"):  # workers find this package where the driver did
        sc.environment["PYTHONPATH"] = f"{root}:{path}" if path else root
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def saved(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder; survives the loss of any executor."""
    return df.checkpoint(eager=True)
