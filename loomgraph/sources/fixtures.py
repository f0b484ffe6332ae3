"""Small typed tables written down as documents: column types by name, rows as lists or objects."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SemanticFault
from .types import spark_type


def tables(spark: SparkSession, doc: dict[str, Any] | str) -> dict[str, DataFrame]:
    """`{"name": {"columns": {"id": "int64", "at": "timestamp"}, "rows": [[1, "2020-01-01"], {"id": 2}]}}`.

    Dates and times are texts in rows; a column that a row leaves out is null; other keys are refused.
    """
    doc = json.loads(doc) if isinstance(doc, str) else doc
    out = {}
    for name, table in doc.items():
        if set(table) - {"columns", "rows"} or "columns" not in table:
            raise SemanticFault(f"{name!r} needs columns, and rows")
        kinds = {c: spark_type(t) for c, t in table["columns"].items()}
        texts = {c for c, t in kinds.items() if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType))}
        schema = T.StructType([T.StructField(c, T.StringType() if c in texts else t) for c, t in kinds.items()])
        rows = []
        for r in table.get("rows", ()):
            if isinstance(r, dict):
                if set(r) - set(kinds):
                    raise SemanticFault(f"{name!r} has no columns {sorted(set(r) - set(kinds))}")
                r = [r.get(c) for c in kinds]
            if len(r) != len(kinds):
                raise SemanticFault(f"a row of {name!r} has {len(r)} values, not {len(kinds)}")
            rows.append(tuple(str(v) if c in texts and v is not None else v for c, v in zip(kinds, r, strict=True)))
        df = spark.createDataFrame(rows, schema)
        out[name] = df.select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in kinds.items()))
    return out
