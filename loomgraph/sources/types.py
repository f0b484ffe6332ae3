"""Declared type names and their Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from ..errors import TypeFault

#: months, days, seconds and nanoseconds are kept apart: a day is no fixed number of hours.
DURATION = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("months", "days", "seconds", "nanos")]
)

NAMES = {
    "boolean": T.BooleanType(), "bool": T.BooleanType(), "string": T.StringType(), "binary": T.BinaryType(), "blob": T.BinaryType(),
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "integer": T.LongType(), "int": T.IntegerType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "serial": T.LongType(),
    "int128": T.DecimalType(38, 0), "uint128": T.DecimalType(38, 0), "bigint": T.DecimalType(38, 0), "bigdecimal": T.DecimalType(38, 18),
    "float32": T.FloatType(), "float": T.DoubleType(), "float64": T.DoubleType(), "double": T.DoubleType(),
    "date": T.DateType(), "time": T.LongType(), "uuid": T.StringType(), "null": T.NullType(),
    "duration": DURATION, "interval": DURATION, "json": T.StringType(),
    **{f"timestamp{p}": T.TimestampNTZType() for p in ("", "_s", "_ms", "_us", "_ns")},
    **{f"timestamptz{p}": T.TimestampType() for p in ("", "_s", "_ms", "_us", "_ns")},
}


def spark_type(text: str) -> T.DataType:
    """`int64`, `decimal:10:2`, `list:int64`, `struct:{a:int64,b:string}`, `INT64[]`, `DECIMAL(10, 2)`, `MAP(string, int64)`."""
    t = text.strip()
    low = t.lower()
    if low.endswith("]"):
        return T.ArrayType(spark_type(t[: t.rindex("[")]))
    if low in NAMES:
        return NAMES[low]
    if m := re.fullmatch(r"decimal[:(]\s*(\d+)\s*[:,]\s*(\d+)\s*\)?", low):
        return T.DecimalType(int(m[1]), int(m[2]))
    if low.startswith("list:"):
        return T.ArrayType(spark_type(t[5:]))
    if low.startswith("domain:"):
        return spark_type(t.split(":", 2)[2])
    if m := re.fullmatch(r"struct:\{(.*)\}", t, re.DOTALL | re.IGNORECASE):
        return T.StructType([T.StructField(n.strip(), spark_type(k)) for n, k in (_split_pair(p, ":") for p in _split(m[1]))])
    if m := re.fullmatch(r"struct\s*\((.*)\)", t, re.DOTALL | re.IGNORECASE):
        return T.StructType([T.StructField(n.strip(), spark_type(k)) for n, k in (_split_pair(p.strip(), None) for p in _split(m[1]))])
    if m := re.fullmatch(r"map\s*\((.*)\)", t, re.DOTALL | re.IGNORECASE):
        k, v = _split(m[1])
        return T.MapType(spark_type(k), spark_type(v))
    raise TypeFault(f"unknown type {text!r}")


def _split(text: str) -> list[str]:
    out, level, at = [], 0, 0
    for i, c in enumerate(text):
        level += (c in "({[") - (c in ")}]")
        if c == "," and level == 0:
            out.append(text[at:i])
            at = i + 1
    return [p for p in [*out, text[at:]] if p.strip()]


def _split_pair(text: str, by: str | None) -> tuple[str, str]:
    a, b = text.split(by, 1)
    return a, b


def numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def whole(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType)


def fraction(t: T.DataType) -> bool:
    return isinstance(t, (T.FloatType, T.DoubleType))


def is_duration(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and t.fieldNames() == DURATION.fieldNames()


def kind(t: T.DataType) -> str:
    """The class of values that compare with each other."""
    if isinstance(t, T.NullType):
        return "null"
    if numeric(t):
        return "number"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.ArrayType):
        return "list"
    if is_duration(t):
        return "duration"
    if isinstance(t, (T.StructType, T.MapType)):
        return "map"
    if isinstance(t, T.DateType):
        return "date"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    return t.typeName()


def cypher_name(t: T.DataType) -> str:
    """The name `typeof` reports."""
    names = {"byte": "INT8", "short": "INT16", "integer": "INT32", "long": "INT64", "float": "FLOAT", "double": "DOUBLE", "void": "NULL", "timestamp_ntz": "TIMESTAMP"}
    if isinstance(t, T.ArrayType):
        return f"{cypher_name(t.elementType)}[]"
    if is_duration(t):
        return "INTERVAL"
    if isinstance(t, T.StructType):
        return "STRUCT(" + ", ".join(f"{f.name} {cypher_name(f.dataType)}" for f in t.fields) + ")"
    return names.get(t.typeName(), t.typeName().upper())
