"""Dates, timestamps and durations. A duration is a struct of months, days, seconds and nanos."""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentFault, TypeFault, UnsupportedFault
from ..sources.types import DURATION, is_duration, kind
from .values import Arg

NANOS = 1_000_000_000
UNITS = {
    "years": ("months", 12), "quarters": ("months", 3), "months": ("months", 1), "weeks": ("days", 7), "days": ("days", 1),
    "hours": ("seconds", 3600), "minutes": ("seconds", 60), "seconds": ("seconds", 1),
    "milliseconds": ("nanos", 1_000_000), "microseconds": ("nanos", 1000), "nanoseconds": ("nanos", 1),
}


def duration(months=0, days=0, seconds=0, nanos=0) -> Column:
    as_col = lambda x: x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long")
    total = as_col(seconds) * NANOS + as_col(nanos)
    return F.struct(
        as_col(months).alias("months"), as_col(days).alias("days"),
        F.floor(total / NANOS).cast("long").alias("seconds"), F.pmod(total, F.lit(NANOS)).cast("long").alias("nanos"),
    )


def duration_of(a: Arg) -> Column:
    """duration(map) or duration(text)."""
    if isinstance(a.type, T.StructType):
        if is_duration(a.type):
            return a.col
        total = {"months": F.lit(0).cast("long"), "days": F.lit(0).cast("long"), "seconds": F.lit(0).cast("long"), "nanos": F.lit(0).cast("long")}
        for f in a.type.fields:
            if f.name not in UNITS:
                raise ArgumentFault(f"unknown duration part {f.name!r}")
            unit, factor = UNITS[f.name]
            total[unit] = total[unit] + (a.col.getField(f.name) * factor).cast("long")
        return duration(**total)
    if a.constant and isinstance(a.value, str):
        return duration(**parse_duration(a.value))
    raise UnsupportedFault("duration() of a column of text")


def parse_duration(text: str) -> dict[str, int]:
    m = re.fullmatch(
        r"(-?)P(?:(-?[\d.]+)Y)?(?:(-?[\d.]+)M)?(?:(-?[\d.]+)W)?(?:(-?[\d.]+)D)?(?:T(?:(-?[\d.]+)H)?(?:(-?[\d.]+)M)?(?:(-?[\d.]+)S)?)?", text
    )
    if not m:
        words = re.findall(r"(-?\d+)\s*(year|quarter|month|week|day|hour|minute|second|millisecond|microsecond)s?", text)
        if not words:
            raise ArgumentFault(f"not a duration: {text!r}")
        out = {"months": 0, "days": 0, "seconds": 0, "nanos": 0}
        for n, unit in words:
            part, factor = UNITS[unit + "s"]
            out[part] += int(n) * factor
        return out
    sign = -1 if m[1] else 1
    y, mo, w, d, h, mi, s = (Fraction(x or 0) for x in m.groups()[1:])
    # a fraction goes down to the next unit: a month has 30.436875 days, a day 24 hours
    months = y * 12 + mo
    days = w * 7 + d + (months - int(months)) * Fraction("30.436875")
    nanos = ((days - int(days)) * 86_400 + h * 3600 + mi * 60 + s) * NANOS
    return {"months": sign * int(months), "days": sign * int(days), "seconds": 0, "nanos": sign * round(nanos)}


def duration_text(d: Column) -> Column:
    f = lambda n: d.getField(n)
    part = lambda n, unit: F.when(n != 0, F.concat(n.cast("string"), F.lit(unit))).otherwise(F.lit(""))
    months, secs = f("months"), f("seconds")
    trunc = lambda n, k: ((n - n % k) / k).cast("long")
    years, rest = trunc(months, 12), months % 12
    h, mi, s = trunc(secs, 3600), trunc(secs % 3600, 60), secs % 60
    digits = F.regexp_replace(F.lpad(f("nanos").cast("string"), 9, "0"), "0+$", "")
    sec = F.when(f("nanos") != 0, F.concat(s.cast("string"), F.lit("."), digits, F.lit("S"))).otherwise(part(s, "S"))
    time = F.concat(part(h, "H"), part(mi, "M"), sec)
    body = F.concat(F.lit("P"), part(years, "Y"), part(rest, "M"), part(f("days"), "D"), F.when(time != "", F.concat(F.lit("T"), time)).otherwise(F.lit("")))
    return F.when(d.isNotNull(), F.when(body == "P", F.lit("PT0S")).otherwise(body))


def shift(moment: Arg, d: Column, sign: int) -> Column:
    months, days = d.getField("months") * sign, d.getField("days") * sign
    if kind(moment.type) == "date":
        secs = d.getField("seconds") * sign
        whole = F.floor(secs / 86400).cast("int") if sign > 0 else F.ceil(secs / 86400).cast("int")
        return F.date_add(F.add_months(moment.col, months.cast("int")), days.cast("int") + whole)
    out = moment.col + F.make_ym_interval(F.lit(0), months.cast("int"))
    total = (d.getField("seconds") * sign).cast("decimal(18,6)") + (d.getField("nanos") * sign / 1000).cast("long").cast("decimal(18,6)") / F.lit(1_000_000)
    return out + F.make_dt_interval(days.cast("int"), F.lit(0), F.lit(0), total.cast("decimal(18,6)"))


def arithmetic(op: str, a: Arg, b: Arg) -> Column:
    ka, kb = kind(a.type), kind(b.type)
    if ka == kb == "duration" and op in "+-":
        sign = 1 if op == "+" else -1
        return duration(**{n: a.col.getField(n) + b.col.getField(n) * sign for n in DURATION.fieldNames()})
    if ka in ("date", "timestamp") and kb == "duration" and op in "+-":
        return shift(a, b.col, 1 if op == "+" else -1)
    if ka == "duration" and kb in ("date", "timestamp") and op == "+":
        return shift(b, a.col, 1)
    if ka == "duration" and kb == "number" and op in "*/":
        scaled = lambda x: (x * b.col if op == "*" else x / b.col).cast("double")
        months = scaled(a.col.getField("months"))
        days = scaled(a.col.getField("days")) + (months - F.floor(months)) * 30.436875
        secs = scaled(a.col.getField("seconds") * NANOS + a.col.getField("nanos")) + (days - F.floor(days)) * 86400 * NANOS
        return duration(F.floor(months), F.floor(days), 0, secs.cast("long"))
    if ka == kb == "date" and op == "-":
        return F.datediff(a.col, b.col).cast("long")
    if ka == "date" and kb == "number" and op in "+-":
        return F.date_add(a.col, b.col.cast("int")) if op == "+" else F.date_sub(a.col, b.col.cast("int"))
    if {ka, kb} <= {"timestamp", "date"} and op == "-":
        return between("seconds", a=b, b=a)
    raise TypeFault(f"{op} is not defined for {ka} and {kb}")


def moment(a: Arg) -> Column:
    if kind(a.type) in ("date", "string"):
        return a.col.cast("timestamp_ntz")
    return a.col


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def between(unit: str, a: Arg, b: Arg) -> Column:
    """The duration from a to b: whole months first, then days, then the clock, or one unit only."""
    x, y = moment(a), moment(b)
    diff = _micros(y) - _micros(x)
    if unit == "seconds":
        return F.when(diff.isNotNull(), duration(0, 0, 0, diff * 1000))
    if unit == "days":
        whole = diff - diff % 86_400_000_000
        return F.when(diff.isNotNull(), duration(0, (whole / 86_400_000_000).cast("long"), 0, 0))
    raw = (F.year(y) * 12 + F.month(y)) - (F.year(x) * 12 + F.month(x))
    moved = F.add_months(x.cast("date"), raw.cast("int")).cast("timestamp_ntz") + (x.cast("timestamp_ntz") - F.date_trunc("day", x).cast("timestamp_ntz"))
    over = F.when(diff >= 0, F.when(_micros(moved) > _micros(y), -1).otherwise(0)).otherwise(F.when(_micros(moved) < _micros(y), 1).otherwise(0))
    months = (raw + over).cast("long")
    if unit == "months":
        return F.when(diff.isNotNull(), duration(months, 0, 0, 0))
    start = F.add_months(x.cast("date"), months.cast("int")).cast("timestamp_ntz") + (x.cast("timestamp_ntz") - F.date_trunc("day", x).cast("timestamp_ntz"))
    rest = _micros(y) - _micros(start)
    days = ((rest - rest % 86_400_000_000) / 86_400_000_000).cast("long")
    return F.when(diff.isNotNull(), duration(months, days, 0, (rest % 86_400_000_000) * 1000))


COMPONENTS = {
    "year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "day": F.dayofmonth, "ordinalDay": F.dayofyear,
    "hour": F.hour, "minute": F.minute,
    "second": lambda c: F.second(c), "dayOfWeek": lambda c: F.weekday(c) + 1, "weekDay": lambda c: F.weekday(c) + 1,
    "millisecond": lambda c: F.pmod((F.unix_micros(c.cast("timestamp")) / 1000).cast("long"), F.lit(1000)),
    "microsecond": lambda c: F.pmod(F.unix_micros(c.cast("timestamp")), F.lit(1_000_000)),
    "nanosecond": lambda c: F.pmod(F.unix_micros(c.cast("timestamp")), F.lit(1_000_000)) * 1000,
    "epochSeconds": lambda c: F.unix_seconds(c.cast("timestamp")), "epochMillis": lambda c: F.unix_millis(c.cast("timestamp")),
    "weekYear": lambda c: F.extract(F.lit("YEAROFWEEK"), c), "dayOfQuarter": lambda c: F.datediff(c, F.trunc(c, "quarter")) + 1,
}


def component(a: Arg, name: str) -> Column | None:
    """`.year` and the like of a date, timestamp or duration; None where there is no such part."""
    if is_duration(a.type):
        d = a.col
        m, s, n = d.getField("months"), d.getField("seconds"), d.getField("nanos")
        trunc = lambda x, k: ((x - x % k) / k).cast("long")
        parts = {
            "years": trunc(m, 12), "quarters": trunc(m, 3), "months": m, "weeks": trunc(d.getField("days"), 7), "days": d.getField("days"),
            "hours": trunc(s, 3600), "minutes": trunc(s, 60), "seconds": s, "milliseconds": s * 1000 + trunc(n, 1_000_000),
            "microseconds": s * 1_000_000 + trunc(n, 1000), "nanoseconds": s * NANOS + n, "monthsOfYear": m % 12, "quartersOfYear": trunc(m, 3) % 4,
            "minutesOfHour": trunc(s, 60) % 60, "secondsOfMinute": s % 60, "daysOfWeek": d.getField("days") % 7,
            "millisecondsOfSecond": trunc(n, 1_000_000), "microsecondsOfSecond": trunc(n, 1000), "nanosecondsOfSecond": n, "monthsOfQuarter": m % 3,
        }
        return parts.get(name)
    if kind(a.type) in ("date", "timestamp") and name in COMPONENTS:
        return COMPONENTS[name](a.col).cast("long")
    return None


def _parts(a: Arg) -> dict[str, Column]:
    return {f.name: a.col.getField(f.name) for f in a.type.fields}


def make_date(a: Arg | None) -> Column:
    if a is None:
        return F.current_date()
    if isinstance(a.type, T.StructType):
        p = _parts(a)
        if "date" in p:
            base = p["date"].cast("date")
            return F.make_date(p.get("year", F.year(base)), p.get("month", F.month(base)), p.get("day", F.dayofmonth(base)))
        if "week" in p:
            first = F.make_date(p["year"].cast("int"), F.lit(1), F.lit(4))
            return F.date_add(F.trunc(first, "week"), ((p["week"] - 1) * 7 + p.get("dayOfWeek", F.lit(1)) - 1).cast("int"))
        if "ordinalDay" in p:
            return F.date_add(F.make_date(p["year"].cast("int"), F.lit(1), F.lit(1)), (p["ordinalDay"] - 1).cast("int"))
        if "quarter" in p:
            start = F.make_date(p["year"].cast("int"), ((p["quarter"] - 1) * 3 + 1).cast("int"), F.lit(1))
            return F.date_add(start, (p.get("dayOfQuarter", F.lit(1)) - 1).cast("int"))
        return F.make_date(p["year"].cast("int"), p.get("month", F.lit(1)).cast("int"), p.get("day", F.lit(1)).cast("int"))
    if kind(a.type) == "string":
        compact = F.regexp_replace(a.col, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
        return compact.cast("date")
    return a.col.cast("date")


def make_moment(a: Arg | None, zoned: bool) -> Column:
    kind_ = "timestamp" if zoned else "timestamp_ntz"
    if a is None:
        return F.current_timestamp().cast(kind_)
    if isinstance(a.type, T.StructType):
        p = _parts(a)
        if "epochSeconds" in p:
            return F.timestamp_seconds(p["epochSeconds"]).cast(kind_)
        if "epochMillis" in p:
            return F.timestamp_millis(p["epochMillis"]).cast(kind_)
        day = make_date(Arg(a.col, T.StructType([f for f in a.type.fields])))
        get = lambda n: p.get(n, F.lit(0)).cast("long")
        micros = ((get("hour") * 60 + get("minute")) * 60 + get("second")) * 1_000_000 + get("millisecond") * 1000 + get("microsecond") + (get("nanosecond") / 1000).cast("long")
        return (day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))).cast(kind_)
    return a.col.cast(kind_)


def clock(a: Arg | None) -> Column:
    """Local time: nanoseconds of the day."""
    if a is None:
        return F.pmod(F.unix_micros(F.current_timestamp()), F.lit(86_400_000_000)) * 1000
    if isinstance(a.type, T.StructType):
        p = _parts(a)
        get = lambda n: p.get(n, F.lit(0)).cast("long")
        return ((get("hour") * 60 + get("minute")) * 60 + get("second")) * NANOS + get("millisecond") * 1_000_000 + get("microsecond") * 1000 + get("nanosecond")
    if kind(a.type) == "string":
        return F.pmod(F.unix_micros(F.concat(F.lit("1970-01-01 "), a.col).cast("timestamp")), F.lit(86_400_000_000)) * 1000
    return F.pmod(F.unix_micros(a.col.cast("timestamp")), F.lit(86_400_000_000)) * 1000


TRUNCATE = {"millennium": 1000, "century": 100, "decade": 10}


def truncate(unit: str, a: Arg, out: str) -> Column:
    unit = unit.lower()
    if unit in TRUNCATE:
        n = TRUNCATE[unit]
        year = F.year(a.col) - F.year(a.col) % n
        return F.make_date(year.cast("int"), F.lit(1), F.lit(1)).cast(out)
    if unit == "weekyear":
        y = F.extract(F.lit("YEAROFWEEK"), a.col)
        return F.trunc(F.make_date(y.cast("int"), F.lit(1), F.lit(4)), "week").cast(out)
    return F.date_trunc(unit, a.col).cast(out)
