"""What the vector searches share: valid vectors, matrices of Arrow lists, block keys, merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one block and queries of one group: what a single task holds at most.
BLOCK_ROWS, GROUP_QUERIES = 4096, 1024


def finite(vectors: DataFrame, vec: str = "embedding", nonzero: bool = False) -> DataFrame:
    """The rows whose vector is neither null nor empty and has no null, NaN or infinite component."""
    x = F.col(vec)
    sane = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    out = vectors.where(x.isNotNull() & (F.size(x) > 0) & F.coalesce(sane, F.lit(False)))
    return out.where(F.exists(x, lambda v: v != 0)) if nonzero else out


def matrix(column: pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    """Rows of equally long lists as a two-dimensional array."""
    if not len(column):
        return np.zeros((0, 0), kind)
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def best(found: DataFrame, k: int, order: list) -> DataFrame:
    """The first k rows of each query under `order`, with their rank from 1."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
