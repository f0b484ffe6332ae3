"""Equality, order and arithmetic of Cypher values as Spark columns."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TypeFault
from ..sources.types import fraction, is_duration, kind, numeric, whole


@dataclass(frozen=True)
class Arg:
    """A compiled argument: its column, its type and, where it is a constant, its value."""

    col: Column
    type: T.DataType
    value: Any = None
    constant: bool = False
    #: for lambdas: a Python function of columns
    fn: Any = None


def null() -> Column:
    return F.lit(None)


def equal(a: Arg, b: Arg) -> Column:
    """`=`: three-valued; NaN equals nothing; values of different classes are unequal, not errors."""
    ka, kb = kind(a.type), kind(b.type)
    if "null" in (ka, kb):
        return null().cast("boolean")
    if ka != kb:
        both = a.col.isNotNull() & b.col.isNotNull()
        return F.when(both, F.lit(False))
    if ka == "number" and (fraction(a.type) and fraction(b.type)) and not (a.constant or b.constant):
        return F.when(F.isnan(a.col) | F.isnan(b.col), F.lit(False) & a.col.isNotNull() & b.col.isNotNull()).otherwise(a.col == b.col)
    if ka == "list":
        ea, eb = a.type.elementType, b.type.elementType
        if "null" in (kind(ea), kind(eb)):
            sizes = F.size(a.col) == F.size(b.col)
            return F.when(sizes & (F.size(a.col) > 0), null().cast("boolean")).otherwise(sizes)
        pairs = F.zip_with(a.col, b.col, lambda x, y: equal(Arg(x, ea), Arg(y, eb)))
        return F.when(F.size(a.col) != F.size(b.col), F.lit(False)).otherwise(F.forall(pairs, lambda p: p))
    if ka == "map" and isinstance(a.type, T.StructType) and isinstance(b.type, T.StructType):
        fa, fb = {f.name: f.dataType for f in a.type.fields}, {f.name: f.dataType for f in b.type.fields}
        if set(fa) != set(fb):
            return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
        out = F.lit(True)
        for n in fa:
            out = out & equal(Arg(a.col.getField(n), fa[n]), Arg(b.col.getField(n), fb[n]))
        return out
    return a.col == b.col


def compare(op: str, a: Arg, b: Arg) -> Column:
    """`<`, `<=`, `>`, `>=`: null unless both are of one class; NaN compares false."""
    ka, kb = kind(a.type), kind(b.type)
    if ka != kb or ka in ("map", "duration", "null"):
        return null().cast("boolean")
    if ka == "list" and kind(a.type.elementType) != kind(b.type.elementType):
        return null().cast("boolean")
    out = {"<": a.col < b.col, "<=": a.col <= b.col, ">": a.col > b.col, ">=": a.col >= b.col}[op]
    for x in (a, b):
        if fraction(x.type) and not x.constant:
            out = F.when(F.isnan(x.col), F.lit(False)).otherwise(out)
    return out


def member(x: Arg, items: Arg) -> Column:
    """`IN`: three-valued."""
    if kind(items.type) == "null":
        return null().cast("boolean")
    if not isinstance(items.type, T.ArrayType):
        raise TypeFault("IN needs a list")
    e = items.type.elementType
    if kind(e) == "null":
        return F.when(F.size(items.col) == 0, F.lit(False))
    if kind(x.type) == "null":
        return F.when(F.size(items.col) == 0, F.lit(False))
    if items.constant and items.value is not None and kind(x.type) == kind(e) and kind(e) in ("number", "string", "boolean"):
        return x.col.isin(*items.value) if items.value else F.when(x.col.isNotNull() | x.col.isNull(), F.lit(False))
    hit = F.exists(items.col, lambda i: equal(x, Arg(i, e)))
    return F.when(F.size(items.col) == 0, F.lit(False)).otherwise(hit)


def wide(a: Arg) -> Column:
    """Whole numbers as 64-bit ones, so that overflow is an error at Cypher's bound."""
    return a.col.cast("long") if whole(a.type) and not isinstance(a.type, T.LongType) else a.col


def arithmetic(op: str, a: Arg, b: Arg) -> Column:
    from . import temporal

    ka, kb = kind(a.type), kind(b.type)
    if "null" in (ka, kb):
        return null()
    if {ka, kb} & {"date", "timestamp", "duration"}:
        return temporal.arithmetic(op, a, b)
    if op == "+":
        if ka == "list" or kb == "list":
            return _append(a, b)
        if "string" in (ka, kb) and {ka, kb} <= {"string", "number", "boolean"}:
            return F.concat(a.col.cast("string"), b.col.cast("string"))
    if not (numeric(a.type) and numeric(b.type)):
        raise TypeFault(f"{op} is not defined for {ka} and {kb}")
    x, y = wide(a), wide(b)
    if op == "+":
        return x + y
    if op == "-":
        return x - y
    if op == "*":
        return x * y
    if op == "%":
        return x % y
    if op == "^":
        return F.pow(x.cast("double"), y.cast("double"))
    if whole(a.type) and whole(b.type):
        return _div(x, y)
    zero = y.cast("double") == 0
    xd, yd = x.cast("double"), y.cast("double")
    limit = F.when(xd > 0, F.lit(float("inf"))).when(xd < 0, F.lit(float("-inf"))).when(xd.isNotNull(), F.lit(float("nan")))
    return F.when(zero, limit).otherwise(F.try_divide(xd, yd))


def _div(x: Column, y: Column) -> Column:
    """Whole-number division, truncating; division by zero is an error."""
    safe = F.when(y == 0, F.raise_error(F.lit("ArithmeticError: / by zero")).cast("long")).otherwise(y)
    # (x - x % y) / y is exact, and a double would not be
    return F.floor(((x - x % safe).cast("decimal(38,0)") / safe.cast("decimal(20,0)"))).cast("long")


def _append(a: Arg, b: Arg) -> Column:
    if kind(a.type) == "list" and kind(b.type) == "list":
        if kind(a.type.elementType) == "null":
            return F.concat(a.col.cast(b.type), b.col)
        if kind(b.type.elementType) == "null":
            return F.concat(a.col, b.col.cast(a.type))
        return F.concat(a.col, b.col)
    if kind(a.type) == "list":
        return F.concat(a.col, F.array(b.col))
    return F.concat(F.array(a.col), b.col)


def ordered(c: Column, descending: bool) -> Column:
    """Sort order of one key: nulls are greatest."""
    return c.desc_nulls_first() if descending else c.asc_nulls_last()


def index(owner: Arg, at: Arg) -> Column:
    """`x[i]`: lists from 0, negative from the end, out of range null; maps by key."""
    if isinstance(owner.type, T.ArrayType):
        if kind(at.type) == "null":
            return null().cast(owner.type.elementType)
        i = at.col.cast("int")
        return F.get(owner.col, F.when(i < 0, i + F.size(owner.col)).otherwise(i))
    if isinstance(owner.type, T.StructType) and at.constant:
        return owner.col.getField(at.value) if at.value in owner.type.fieldNames() else null()
    if isinstance(owner.type, T.MapType):
        return F.try_element_at(owner.col, at.col)
    if kind(owner.type) == "null":
        return null()
    raise TypeFault(f"cannot subscript a {kind(owner.type)}")


def piece(owner: Arg, low: Arg | None, high: Arg | None) -> Column:
    """`x[a..b]`: half open, negative bounds from the end, null bounds give null."""
    n = F.size(owner.col) if isinstance(owner.type, T.ArrayType) else F.length(owner.col)

    def bound(b: Arg | None, default: Column) -> Column:
        if b is None:
            return default
        i = b.col.cast("int")
        return F.greatest(F.lit(0), F.least(n, F.when(i < 0, i + n).otherwise(i)))

    lo, hi = bound(low, F.lit(0)), bound(high, n)
    count = F.greatest(F.lit(0), hi - lo)
    missing = owner.col.isNull()
    for b in (low, high):
        if b is not None:
            missing = missing | b.col.isNull()
    if isinstance(owner.type, T.ArrayType):
        body = F.slice(owner.col, lo + 1, count)
    else:
        body = F.substring(owner.col, lo + 1, count)
    return F.when(~missing, body)


def text(a: Arg) -> Column:
    """How a value prints."""
    t = a.type
    if isinstance(t, T.ArrayType):
        inner = F.transform(a.col, lambda x: F.coalesce(text(Arg(x, t.elementType)), F.lit("")))
        return F.concat(F.lit("["), F.array_join(inner, ","), F.lit("]"))
    if is_duration(t):
        from . import temporal

        return temporal.duration_text(a.col)
    if isinstance(t, T.StructType):
        parts = [F.concat(F.lit(f"{f.name}: "), F.coalesce(text(Arg(a.col.getField(f.name), f.dataType)), F.lit(""))) for f in t.fields]
        return F.when(a.col.isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))
    return a.col.cast("string")
