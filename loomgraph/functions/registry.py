"""Scalar functions by name: each builds a Spark column from compiled arguments."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentFault, SemanticFault, TypeFault, UnsupportedFault
from ..sources.types import cypher_name, fraction, is_duration, kind, numeric, spark_type, whole
from . import jsonfns, temporal
from . import values as V
from .values import Arg

Builder = Callable[..., Column]
FUNCTIONS: dict[str, Builder] = {}


def register(*names: str) -> Callable[[Builder], Builder]:
    def put(fn: Builder) -> Builder:
        for n in names:
            FUNCTIONS[n.lower()] = fn
        return fn

    return put


def plain(fn: Callable[..., Column], *names: str) -> None:
    """A function of columns only."""
    register(*names)(lambda *args: fn(*(a.col for a in args)))


def _double(c: Column) -> Column:
    return c.cast("double")


# --- math -----------------------------------------------------------------------------------

for _name, _fn in {
    "sqrt": F.sqrt, "cbrt": F.cbrt, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan, "cot": F.cot, "asin": F.asin, "acos": F.acos,
    "atan": F.atan, "degrees": F.degrees, "radians": F.radians, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh,
    "acosh": F.acosh, "atanh": F.atanh, "signum": F.signum,
}.items():
    plain((lambda f: lambda x: f(_double(x)))(_fn), _name, f"fn.{_name}")

plain(lambda x: F.ceil(_double(x)).cast("double"), "ceil", "fn.ceil")
plain(lambda x: F.floor(_double(x)).cast("double"), "floor", "fn.floor")
plain(lambda x, y: F.atan2(_double(x), _double(y)), "atan2", "fn.atan2")
plain(lambda x, y: F.pow(_double(x), _double(y)), "pow", "power", "fn.power")
plain(lambda: F.pi(), "pi", "fn.pi")
plain(lambda: F.e(), "e")
plain(lambda: F.rand(), "rand", "random", "fn.random")
plain(lambda x: F.pow(F.sin(_double(x) / 2), F.lit(2.0)), "haversin")
plain(lambda x: F.signum(_double(x)).cast("long"), "sign")
plain(lambda x: F.when((x >= 0) & (x <= 20), F.factorial(x.cast("int"))), "factorial", "fn.factorial")
plain(lambda a, b: a.cast("long").bitwiseAND(b.cast("long")), "bitwise_and")
plain(lambda a, b: a.cast("long").bitwiseOR(b.cast("long")), "bitwise_or")
plain(lambda a, b: F.call_function("shiftleft", a.cast("long"), b.cast("int")), "bitshift_left")
plain(lambda a, b: F.call_function("shiftright", a.cast("long"), b.cast("int")), "bitshift_right")
plain(lambda x: (lambda c: F.when(c % 2 == 0, c).otherwise(c + 1))(F.ceil(_double(x)).cast("double")), "even")
plain(lambda x: x % 2 != 0, "odd")
plain(lambda a, b: a % b, "mod")
plain(lambda x: F.isnan(_double(x)), "isnan", "fn.isnan")
plain(lambda x: x == 0, "iszero", "fn.iszero")
plain(lambda a, b: F.nanvl(_double(a), _double(b)), "fn.nanvl")
plain(F.nullif, "nullif", "fn.nullif")
plain(F.nvl2, "fn.nvl2")


@register("abs", "fn.abs")
def _abs(x: Arg) -> Column:
    return F.abs(V.wide(x))


@register("negate")
def _negate(x: Arg) -> Column:
    return -V.wide(x)


@register("multiply")
def _multiply(a: Arg, b: Arg) -> Column:
    return V.arithmetic("*", a, b)


def _log(fn: Callable[[Column], Column]) -> Builder:
    def build(x: Arg) -> Column:
        c = _double(x.col)
        return F.when(c > 0, fn(c)).when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan"))).otherwise(c)

    return build


register("ln", "fn.ln")(_log(F.ln))


@register("fn.log")
def _log_base(a: Arg, b: Arg | None = None) -> Column:
    """log(x) to base 10, log(base, x)."""
    return _log(F.log10)(a) if b is None else _log(F.ln)(b) / _log(F.ln)(a)


register("log", "log10", "fn.log10")(_log(F.log10))
register("log2", "fn.log2")(_log(F.log2))


@register("round", "fn.round")
def _round(x: Arg, n: Arg | None = None) -> Column:
    return F.round(_double(x.col), n.value if n is not None else 0)


@register("fn.trunc")
def _trunc(x: Arg) -> Column:
    return F.when(x.col >= 0, F.floor(_double(x.col))).otherwise(F.ceil(_double(x.col))).cast("double")


@register("gcd", "fn.gcd")
def _gcd(a: Arg, b: Arg) -> Column:
    """Euclid's steps as a fold: two longs need fewer than 93 of them."""
    x, y = F.abs(a.col.cast("long")), F.abs(b.col.cast("long"))
    zero = F.lit(0).cast("long")
    step = lambda s, _: F.struct(s["y"].alias("x"), F.when(s["y"] == 0, zero).otherwise(s["x"] % s["y"]).alias("y"))
    start = F.struct(F.greatest(x, y).alias("x"), F.least(x, y).alias("y"))
    keep = lambda s, i: F.when(s["y"] == 0, s).otherwise(step(s, i))
    return F.when(x.isNotNull() & y.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, keep, lambda s: s["x"]))


@register("lcm", "fn.lcm")
def _lcm(a: Arg, b: Arg) -> Column:
    g = _gcd(a, b)
    return F.when((a.col == 0) | (b.col == 0), F.lit(0).cast("long")).otherwise((F.abs(a.col * b.col) / g).cast("long"))


#: The Lanczos series of nine terms around 7.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def _lgamma(x: Column) -> Column:
    """ln |gamma(x)| by the Lanczos series, and by reflection below one half."""

    def above(z: Column) -> Column:
        total = F.lit(LANCZOS[0])
        for i, c in enumerate(LANCZOS[1:]):
            total = total + F.lit(c) / (z + F.lit(float(i)))
        t = z + F.lit(6.5)
        return F.lit(0.5 * math.log(2 * math.pi)) + (z - 0.5) * F.ln(t) - t + F.ln(total)

    below = F.ln(F.lit(math.pi) / F.abs(F.sin(F.lit(math.pi) * x))) - above(F.lit(1.0) - x)
    pole = (x <= 0) & (x == F.floor(x))
    return F.when(pole, F.lit(float("inf"))).when(x < 0.5, below).otherwise(above(x))


def _gamma(name: str) -> Builder:
    def build(x: Arg) -> Column:
        c = _double(x.col)
        if name == "lgamma":
            return _lgamma(c)
        sign = F.when((c < 0) & (F.floor(c).cast("long") % 2 != 0), F.lit(-1.0)).otherwise(F.lit(1.0))
        exact = F.when((c == F.floor(c)) & (c >= 1) & (c <= 21), F.factorial((c - 1).cast("int")).cast("double"))
        return F.coalesce(exact, sign * F.exp(_lgamma(c)))

    return build


register("gamma")(_gamma("gamma"))
register("lgamma")(_gamma("lgamma"))


@register("greatest", "fn.greatest")
def _greatest(*xs: Arg) -> Column:
    return xs[0].col if len(xs) == 1 else F.greatest(*(x.col for x in xs))


@register("least", "fn.least")
def _least(*xs: Arg) -> Column:
    return xs[0].col if len(xs) == 1 else F.least(*(x.col for x in xs))


# --- null and choice ------------------------------------------------------------------------


@register("coalesce", "cypher_coalesce", "ifnull", "nvl", "fn.coalesce", "fn.nvl")
def _coalesce(*xs: Arg) -> Column:
    return F.coalesce(*(x.col for x in xs))


plain(lambda c, g: F.when(g.isNotNull(), c), "constant_or_null")
plain(lambda x: x.isNotNull(), "exists")
plain(lambda m: F.raise_error(m.cast("string")), "error")
plain(lambda a, b: (a & ~b) | (~a & b), "xor")


@register("in", "cypher_in")
def _in(x: Arg, xs: Arg) -> Column:
    return V.member(x, xs)


for _op, _names in {"<": "lt", "<=": "lte", ">": "gt", ">=": "gte"}.items():
    register(f"cypher_{_names}")((lambda op: lambda a, b: V.compare(op, a, b))(_op))
register("cypher_eq")(lambda a, b: V.equal(a, b))
register("cypher_neq")(lambda a, b: ~V.equal(a, b))
register("cypher_order_key", "cypher_properties")(lambda a: a.col)

# --- strings --------------------------------------------------------------------------------

WHITE = r"(?U)\s"
plain(F.lower, "lower", "lcase", "tolower", "fn.lower")
plain(F.upper, "upper", "ucase", "toupper", "fn.upper")
plain(F.levenshtein, "levenshtein", "fn.levenshtein")
plain(F.initcap, "initcap", "fn.initcap")
plain(F.md5, "md5", "fn.md5")
plain(F.sha1, "sha1")
plain(lambda x: F.xxhash64(x), "hash")
plain(F.octet_length, "octet_length", "fn.octet_length")
plain(F.bit_length, "fn.bit_length")
plain(lambda s, n: F.when(n >= 0, F.repeat(s, n.cast("int"))), "repeat", "fn.repeat")
plain(lambda s, a, b: F.when(s.isNotNull() & a.isNotNull() & b.isNotNull(), F.replace(s, a, b)), "replace", "fn.replace")
plain(lambda s, sub: F.call_function("instr", s, sub), "fn.strpos", "fn.instr")
plain(lambda s: F.ascii(s), "fn.ascii")
plain(lambda n: F.char(n.cast("long")), "fn.chr")
plain(lambda n: F.lower(F.hex(n)), "fn.to_hex")
plain(lambda s, a, b: F.call_function("translate", s, a, b), "fn.translate")
plain(lambda s, d, n: F.call_function("substring_index", s, d, n.cast("int")), "fn.substr_index")
plain(lambda s, l: F.find_in_set(s, l), "fn.find_in_set")
plain(lambda s, r, p: F.overlay(s, r, p), "fn.overlay")
plain(lambda: F.uuid(), "gen_random_uuid", "fn.uuid")
plain(lambda s: F.when(s.rlike("^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"), F.lower(s)), "uuid", "touuid")
plain(lambda s: F.encode(s, "UTF-8"), "encode", "blob", "to_blob", "fn.encode")
plain(lambda b: F.decode(b, "UTF-8"), "decode", "fn.decode")
plain(lambda s, p: F.regexp_like(s, p), "regexp_matches", "fn.regexp_like")
plain(lambda s, p: F.regexp_like(s, F.concat(F.lit(r"\A(?:"), p, F.lit(r")\z"))), "regex_match", "regexp_full_match")
plain(lambda s, p: F.regexp_count(s, p), "fn.regexp_count")
plain(lambda s, p: F.regexp_instr(s, p), "fn.regexp_instr")
for _bits in (224, 256, 384, 512):
    plain((lambda b: lambda s: F.sha2(s, b))(_bits), f"sha{_bits}", f"fn.sha{_bits}")


@register("fn.digest")
def _digest(s: Arg, method: Arg) -> Column:
    name = str(method.value).lower()
    if name == "md5":
        return F.unhex(F.md5(s.col.cast("binary")))
    if name not in ("sha224", "sha256", "sha384", "sha512"):
        raise ArgumentFault(f"no digest {name!r}")
    return F.unhex(F.sha2(s.col.cast("binary"), int(name[3:])))


def _stripped(where: str) -> Builder:
    def build(s: Arg, chars: Arg | None = None) -> Column:
        c = s.col
        if chars is not None:
            fn = {"both": F.btrim, "left": F.ltrim, "right": F.rtrim}[where]
            return fn(c, chars.col)
        if where in ("both", "left"):
            c = F.regexp_replace(c, f"^{WHITE}+", "")
        if where in ("both", "right"):
            c = F.regexp_replace(c, f"{WHITE}+$", "")
        return c

    return build


register("trim", "btrim", "fn.btrim")(_stripped("both"))
register("ltrim", "fn.ltrim")(_stripped("left"))
register("rtrim", "fn.rtrim")(_stripped("right"))


@register("length", "size", "len", "cardinality", "list_size", "list_length", "list_count", "array_length", "fn.cardinality", "fn.array_length", "fn.character_length")
def _length(x: Arg) -> Column:
    if isinstance(x.type, (T.ArrayType, T.MapType)):
        return F.when(x.col.isNotNull(), F.size(x.col).cast("long"))
    if isinstance(x.type, T.StructType):
        if x.type.fieldNames() == ["nodes", "relationships"]:
            return F.when(x.col.isNotNull(), F.size(x.col.getField("relationships")).cast("long"))
        return F.when(x.col.isNotNull(), F.lit(len(x.type.fields)).cast("long"))
    return F.length(x.col.cast("string")).cast("long")


@register("isempty", "fn.empty")
def _empty(x: Arg) -> Column:
    return _length(x) == 0


@register("reverse", "list_reverse", "fn.reverse", "fn.array_reverse")
def _reverse(x: Arg) -> Column:
    return F.reverse(x.col)


@register("substring")
def _substring(s: Arg, start: Arg, n: Arg | None = None) -> Column:
    begin = start.col.cast("int") + 1
    return F.substring(s.col, begin, n.col.cast("int") if n is not None else F.lit(2**31 - 1))


@register("substr", "fn.substr")
def _substr(s: Arg, start: Arg, n: Arg | None = None) -> Column:
    return F.substring(s.col, start.col.cast("int"), n.col.cast("int") if n is not None else F.lit(2**31 - 1))


@register("left", "fn.left")
def _left(s: Arg, n: Arg) -> Column:
    k = n.col.cast("int")
    return F.substring(s.col, F.lit(1), F.when(k < 0, F.greatest(F.lit(0), F.length(s.col) + k)).otherwise(k))


@register("right", "fn.right")
def _right(s: Arg, n: Arg) -> Column:
    k = n.col.cast("int")
    take = F.when(k < 0, F.greatest(F.lit(0), F.length(s.col) + k)).otherwise(F.least(k, F.length(s.col)))
    return F.substring(s.col, F.length(s.col) - take + 1, take)


@register("split", "string_split", "str_split", "string_to_array", "fn.string_to_array")
def _split(s: Arg, by: Arg) -> Column:
    if by.constant:
        return F.split(s.col, re.escape(by.value) if by.value else "", -1) if by.value is not None else V.null().cast("array<string>")
    quoted = F.concat(F.lit("\\Q"), by.col, F.lit("\\E"))
    return F.split(s.col, quoted, F.lit(-1))


plain(lambda s, d, n: F.split_part(s, d, n.cast("int")), "split_part", "fn.split_part")


@register("concat", "fn.concat", "list_concat", "array_concat", "list_cat", "array_cat", "fn.array_concat", "format_concat")
def _concat(*xs: Arg) -> Column:
    if any(isinstance(x.type, T.ArrayType) for x in xs):
        return F.concat(*(x.col for x in xs))
    return F.concat(*(x.col.cast("string") for x in xs))


@register("concat_ws", "fn.concat_ws")
def _concat_ws(sep: Arg, *xs: Arg) -> Column:
    return F.concat_ws(sep.value, *(x.col for x in xs))


plain(lambda s, n, p: F.lpad(s, n.cast("int"), p), "lpad", "fn.lpad")
plain(lambda s, n, p: F.rpad(s, n.cast("int"), p), "rpad", "fn.rpad")


def _part(fn: Callable[[Column, Column], Column]) -> Builder:
    def build(a: Arg, b: Arg) -> Column:
        if kind(a.type) != "string" or kind(b.type) != "string":
            return V.null().cast("boolean")
        return fn(a.col, b.col)

    return build


register("contains", "contains_fn", "fn.contains")(_part(F.contains))
register("starts_with", "startswith", "fn.starts_with")(_part(F.startswith))
register("ends_with", "endswith", "fn.ends_with")(_part(F.endswith))


@register("prefix")
def _prefix(s: Arg, p: Arg) -> Column:
    return F.startswith(s.col, p.col) if kind(p.type) == "string" else _left(s, p)


@register("suffix")
def _suffix(s: Arg, p: Arg) -> Column:
    return F.endswith(s.col, p.col) if kind(p.type) == "string" else _right(s, p)


@register("regexp_replace", "fn.regexp_replace")
def _regexp_replace(s: Arg, p: Arg, r: Arg, flags: Arg | None = None) -> Column:
    if flags is not None and "g" in (flags.value or ""):
        return F.regexp_replace(s.col, p.col, r.col)
    at = F.regexp_instr(s.col, p.col)
    hit = F.regexp_substr(s.col, p.col)
    head = F.substring(s.col, F.lit(1), at - 1)
    tail = F.substring(s.col, at + F.length(hit), F.lit(2**31 - 1))
    return F.when(hit.isNull(), s.col).otherwise(F.concat(head, F.regexp_replace(hit, p.col, r.col), tail))


@register("regexp_extract")
def _regexp_extract(s: Arg, p: Arg, g: Arg | None = None) -> Column:
    return F.regexp_extract(s.col, p.value, g.value if g is not None else 0)


@register("regexp_extract_all", "fn.regexp_match")
def _regexp_extract_all(s: Arg, p: Arg, g: Arg | None = None) -> Column:
    return F.regexp_extract_all(s.col, p.col, F.lit(g.value if g is not None else 0))


@register("regexp_split_to_array")
def _regexp_split(s: Arg, p: Arg) -> Column:
    parts = F.split(s.col, p.value, -1)
    return F.when(F.try_element_at(parts, F.lit(-1)) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


@register("conjoin")
def _conjoin(xs: Arg, sep: Arg) -> Column:
    return F.array_join(xs.col, sep.value)


@register("format_placeholder")
def _placeholder(template: Arg, name: Arg, value: Arg) -> Column:
    return F.replace(template.col, F.concat(F.lit("{"), name.col, F.lit("}")), V.text(value))


# --- lists ----------------------------------------------------------------------------------

plain(F.array_append, "list_append", "array_append", "array_push_back", "fn.array_append")
plain(F.array_distinct, "fn.array_distinct")
plain(lambda x: F.array_distinct(F.array_compact(x)), "list_distinct")
plain(lambda x: F.size(F.array_distinct(F.array_compact(x))).cast("long"), "list_unique")
plain(lambda x: F.get(F.array_compact(x), F.lit(0)), "list_any_value", "fn.array_any_value")
plain(lambda x: F.array_min(x), "list_min", "fn.array_min")
plain(lambda x: F.array_max(x), "list_max", "fn.array_max")
plain(lambda x: F.get(x, F.lit(0)), "head")
plain(lambda x: F.get(x, F.size(x) - 1), "last")
plain(lambda x: F.when(F.size(x) > 0, F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0)))).otherwise(x), "tail", "fn.array_pop_front")
plain(lambda x: F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), "fn.array_pop_back")
plain(F.array_union, "list_merge", "fn.array_union")
plain(F.array_intersect, "list_intersect", "fn.array_intersect")
plain(F.array_except, "list_difference", "fn.array_except")
plain(lambda a, b: F.array_union(F.array_except(a, b), F.array_except(b, a)), "list_disjunct")
plain(lambda a, b: F.concat(a, b), "list_combine")
plain(F.flatten, "flatten", "fn.flatten")
plain(lambda h, n: F.arrays_overlap(h, n), "fn.array_has_any")
plain(lambda h, n: F.forall(n, lambda x: x.isNull() | F.array_contains(h, x)), "list_has_all", "fn.array_has_all")
plain(lambda x, v: F.array_remove(x, v), "fn.array_remove_all")
plain(lambda x, a, b: F.transform(x, lambda v: F.when(v == a, b).otherwise(v)), "fn.array_replace_all")
plain(lambda v, n: F.array_repeat(v, n.cast("int")), "fn.array_repeat")
plain(lambda x, s: F.call_function("array_join", x, s), "fn.array_to_string")
plain(lambda *xs: F.arrays_zip(*xs), "fn.arrays_zip")
plain(lambda x, v: F.transform(F.filter(F.transform(x, lambda y, i: F.struct(y.alias("y"), (i + 1).alias("i"))), lambda s: s["y"] == v), lambda s: s["i"].cast("long")), "fn.array_positions")
plain(lambda x: F.transform(x, lambda v, i: F.struct(v.alias("value"), i.cast("long").alias("index"))), "index_list")


def _ndims(t: T.DataType) -> int:
    return 1 + _ndims(t.elementType) if isinstance(t, T.ArrayType) else 0


@register("fn.array_ndims")
def _array_ndims(x: Arg) -> Column:
    return F.when(x.col.isNotNull(), F.lit(_ndims(x.type)).cast("long"))


@register("fn.array_dims")
def _array_dims(x: Arg) -> Column:
    sizes, at, t = [], x.col, x.type
    while isinstance(t, T.ArrayType):
        sizes.append(F.size(at).cast("long"))
        at, t = F.get(at, F.lit(0)), t.elementType
    return F.when(x.col.isNotNull(), F.array(*sizes))


def _nth_of(x: Column, v: Column) -> Column:
    """(value, its number among equal ones) of each element."""
    return F.transform(x, lambda y, i: F.struct(y.alias("y"), F.when(y.eqNullSafe(v), F.size(F.filter(F.slice(x, F.lit(1), i + 1), lambda z: z.eqNullSafe(v)))).alias("n")))


plain(lambda x, v, n: F.transform(F.filter(_nth_of(x, v), lambda s: s["n"].isNull() | (s["n"] > n)), lambda s: s["y"]), "fn.array_remove_n")
plain(lambda x, v: F.transform(F.filter(_nth_of(x, v), lambda s: s["n"].isNull() | (s["n"] > 1)), lambda s: s["y"]), "fn.array_remove")
plain(lambda x, a, b, n: F.transform(_nth_of(x, a), lambda s: F.when(s["n"] <= n, b).otherwise(s["y"])), "fn.array_replace_n")
plain(lambda x, a, b: F.transform(_nth_of(x, a), lambda s: F.when(s["n"] == 1, b).otherwise(s["y"])), "fn.array_replace")


@register("fn.array_resize")
def _resize(x: Arg, n: Arg, fill: Arg | None = None) -> Column:
    k = F.greatest(n.col.cast("int"), F.lit(0))
    t = x.type.elementType
    more = F.array_repeat(fill.col.cast(t) if fill is not None else F.lit(None).cast(t), F.greatest(k - F.size(x.col), F.lit(0)))
    return F.slice(F.concat(x.col, more), F.lit(1), k)


@register("appendelement")
def _append_element(xs: Arg, x: Arg, keep: Arg) -> Column:
    """The list with `x` at its end, or as it is where `keep` is not true."""
    return F.when(keep.col.cast("boolean"), F.array_append(xs.col, x.col)).otherwise(xs.col)


@register("fn.struct")
def _fn_struct(*xs: Arg) -> Column:
    return F.struct(*(x.col.alias(f"c{i}") for i, x in enumerate(xs)))


plain(lambda: F.lit("1.0"), "fn.version")
register("fn.arrow_metadata")(lambda x, key=None: F.create_map().cast("map<string,string>") if key is None else F.lit(None).cast("string"))


@register("list_prepend", "array_prepend", "array_push_front", "fn.array_prepend")
def _prepend(a: Arg, b: Arg) -> Column:
    return F.array_prepend(a.col, b.col) if isinstance(a.type, T.ArrayType) else F.array_prepend(b.col, a.col)


@register("list_creation", "array_value", "make_array", "fn.make_array")
def _array(*xs: Arg) -> Column:
    return F.array(*(x.col for x in xs))


@register("set_literal")
def _set(x: Arg) -> Column:
    return F.array_distinct(x.col)


@register("list_element", "list_extract", "array_extract", "element_at", "list_at", "fn.array_element")
def _element(xs: Arg, i: Arg) -> Column:
    if kind(xs.type) == "string":
        return F.substring(xs.col, i.col.cast("int"), F.lit(1))
    if isinstance(xs.type, T.MapType):
        return F.try_element_at(xs.col, i.col)
    k = i.col.cast("int")
    return F.get(xs.col, F.when(k > 0, k - 1).when(k < 0, F.size(xs.col) + k))


@register("list_position", "list_indexof", "array_indexof", "array_position", "fn.array_position")
def _position(xs: Arg, x: Arg) -> Column:
    return F.array_position(xs.col, x.col).cast("long")


@register("list_contains", "array_contains", "array_has", "list_has", "fn.array_has")
def _contains(xs: Arg, x: Arg) -> Column:
    return F.when(xs.col.isNotNull(), F.coalesce(F.array_contains(xs.col, x.col), F.lit(False)))


@register("list_slice", "array_slice", "fn.array_slice")
def _list_slice(xs: Arg, low: Arg, high: Arg) -> Column:
    if kind(xs.type) == "string":
        return F.substring(xs.col, low.col.cast("int"), high.col.cast("int") - low.col.cast("int") + 1)
    n = F.size(xs.col)
    pos = lambda b: F.when(b < 0, n + b + 1).otherwise(b)
    lo = F.greatest(F.lit(1), pos(low.col.cast("int")))
    return F.slice(xs.col, lo, F.greatest(F.lit(0), F.least(n, pos(high.col.cast("int"))) - lo + 1))


@register("list_sort", "array_sort", "fn.array_sort")
def _sort(xs: Arg, way: Arg | None = None, nulls: Arg | None = None) -> Column:
    down = way is not None and str(way.value).upper() == "DESC"
    last = nulls is not None and "LAST" in str(nulls.value).upper()
    body = F.sort_array(F.array_compact(xs.col), not down)
    gaps = F.filter(xs.col, lambda v: v.isNull())
    return F.concat(body, gaps) if last else F.concat(gaps, body)


@register("list_reverse_sort")
def _reverse_sort(xs: Arg, nulls: Arg | None = None) -> Column:
    return _sort(xs, Arg(F.lit("DESC"), T.StringType(), "DESC", True), nulls)


def _folded(xs: Arg, start: float, step: Callable[[Column, Column], Column]) -> Column:
    exact = whole(xs.type.elementType)
    zero = F.lit(int(start)).cast("long") if exact else F.lit(float(start))
    return F.aggregate(F.array_compact(xs.col), zero, lambda a, v: step(a, v.cast("long" if exact else "double")))


register("list_sum")(lambda xs: _folded(xs, 0, lambda a, v: a + v))
register("list_product")(lambda xs: _folded(xs, 1, lambda a, v: a * v))


@register("list_avg")
def _list_avg(xs: Arg) -> Column:
    n = F.size(F.array_compact(xs.col))
    return F.when(n > 0, F.aggregate(F.array_compact(xs.col), F.lit(0.0), lambda a, v: a + v.cast("double")) / n)


@register("list_to_string", "list_join")
def _list_join(a: Arg, b: Arg) -> Column:
    xs, sep = (a, b) if isinstance(a.type, T.ArrayType) else (b, a)
    return F.call_function("array_join", F.transform(xs.col, lambda v: v.cast("string")), sep.col)


@register("list_transform")
def _list_transform(xs: Arg, f: Arg) -> Column:
    return F.transform(xs.col, f.fn)


@register("list_filter")
def _list_filter(xs: Arg, f: Arg) -> Column:
    return F.filter(xs.col, f.fn)


@register("list_reduce")
def _list_reduce(xs: Arg, f: Arg) -> Column:
    return F.when(F.size(xs.col) > 0, F.reduce(F.slice(xs.col, F.lit(2), F.greatest(F.size(xs.col) - 1, F.lit(0))), F.get(xs.col, F.lit(0)), f.fn))


@register("range", "cypher_range", "fn.range", "fn.generate_series")
def _range(a: Arg, b: Arg, step: Arg | None = None) -> Column:
    lo, hi = a.col.cast("long"), b.col.cast("long")
    by = step.col.cast("long") if step is not None else F.lit(1).cast("long")
    if step is not None and step.constant and step.value == 0:
        raise ArgumentFault("range() needs a step other than 0")
    fits = ((by > 0) & (lo <= hi)) | ((by < 0) & (lo >= hi))
    body = F.sequence(F.when(fits, lo).otherwise(F.lit(0).cast("long")), F.when(fits, hi).otherwise(F.lit(0).cast("long")), F.when(fits, by).otherwise(F.lit(1).cast("long")))
    return F.when(lo.isNotNull() & hi.isNotNull() & by.isNotNull(), F.when(fits, body).otherwise(F.array().cast("array<bigint>")))


# --- vectors --------------------------------------------------------------------------------


def _vec(a: Arg) -> Column:
    return a.col.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _same(a: Arg, b: Arg, out: Column) -> Column:
    return F.when(F.size(a.col) == F.size(b.col), out)


@register("array_dot_product", "array_inner_product", "dot_product", "vector.dot")
def _dot(a: Arg, b: Arg) -> Column:
    return _same(a, b, dot(_vec(a), _vec(b)))


@register("array_squared_distance")
def _squared(a: Arg, b: Arg) -> Column:
    d = F.zip_with(_vec(a), _vec(b), lambda x, y: (x - y) * (x - y))
    return _same(a, b, F.aggregate(d, F.lit(0.0), lambda s, v: s + v))


@register("array_distance", "vector.l2_distance", "fn.array_distance")
def _distance(a: Arg, b: Arg) -> Column:
    return F.sqrt(_squared(a, b))


@register("array_cosine_similarity", "vector.cosine_similarity")
def _cosine(a: Arg, b: Arg) -> Column:
    norms = F.sqrt(dot(_vec(a), _vec(a))) * F.sqrt(dot(_vec(b), _vec(b)))
    return _same(a, b, F.when(norms > 0, dot(_vec(a), _vec(b)) / norms))


@register("array_cross_product")
def _cross(a: Arg, b: Arg) -> Column:
    x, y = [_vec(a)[i] for i in range(3)], [_vec(b)[i] for i in range(3)]
    return F.array(x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0])


@register("vector.maxsim")
def _maxsim(a: Arg, b: Arg) -> Column:
    """Sum over the query's tokens of the best dot product with a document token."""
    best = lambda q: F.array_max(F.transform(b.col.cast("array<array<double>>"), lambda t: dot(q, t)))
    return F.aggregate(F.transform(a.col.cast("array<array<double>>"), best), F.lit(0.0), lambda s, v: s + v)


# --- maps, structs, unions ------------------------------------------------------------------


@register("map", "map_literal", "fn.map")
def _map(keys: Arg, vals: Arg) -> Column:
    return F.map_from_arrays(keys.col, vals.col)


@register("make_map")
def _make_map(*xs: Arg) -> Column:
    return F.create_map(*(x.col for x in xs))


@register("struct_pack", "named_struct", "fn.named_struct")
def _struct(*xs: Arg) -> Column:
    return F.struct(*(v.col.alias(k.value) for k, v in zip(xs[::2], xs[1::2], strict=True)))


@register("map_keys", "fn.map_keys")
def _map_keys(m: Arg) -> Column:
    return F.map_keys(m.col) if isinstance(m.type, T.MapType) else F.array(*(F.lit(f) for f in m.type.fieldNames()))


@register("map_values", "fn.map_values")
def _map_values(m: Arg) -> Column:
    return F.map_values(m.col) if isinstance(m.type, T.MapType) else F.array(*(m.col.getField(f) for f in m.type.fieldNames()))


plain(F.map_entries, "fn.map_entries")
plain(lambda m, k: F.filter(F.array(F.try_element_at(m, k)), lambda v: v.isNotNull()), "map_extract", "map_extract_value", "fn.map_extract")
plain(lambda m, k: F.map_contains_key(m, k), "map_has_key")
plain(lambda m, k: F.try_element_at(m, k), "map_get_display")


@register("struct_extract", "struct_extract_by_name", "fn.get_field", "property", "property_value")
def _field(s: Arg, name: Arg) -> Column:
    return V.index(s, name)


@register("keys")
def _keys(m: Arg) -> Column:
    if isinstance(m.type, T.MapType):
        return F.map_keys(m.col)
    body = m.type["properties"].dataType if "properties" in m.type.fieldNames() else m.type
    owner = m.col.getField("properties") if "properties" in m.type.fieldNames() else m.col
    names = F.array(*(F.when(owner.getField(f).isNotNull(), F.lit(f)) for f in body.fieldNames()))
    return F.when(m.col.isNotNull(), F.array_compact(names))


@register("union_value")
def _union_value(tag: Arg, value: Arg) -> Column:
    return F.struct(tag.col.alias("tag"), value.col.alias(str(tag.value)))


register("union_tag", "fn.union_tag")(lambda u: u.col.getField("tag"))
register("union_extract", "union_extract_by_tag", "fn.union_extract")(lambda u, t: F.when(u.col.getField("tag") == t.value, u.col.getField(t.value)))


# --- types and casts ------------------------------------------------------------------------


@register("typeof", "fn.arrow_typeof")
def _typeof(x: Arg) -> Column:
    return F.lit(cypher_name(x.type))


@register("typeof_matches")
def _typeof_matches(x: Arg, name: Arg) -> Column:
    return F.lit(cypher_name(x.type) == str(name.value).upper())


@register("tointeger", "toint", "cypher_convert.tointeger", "toint64")
def _to_integer(x: Arg) -> Column:
    k = kind(x.type)
    if k in ("list", "map"):
        raise TypeFault("toInteger() takes no list or map")
    if k == "string":
        t = F.trim(x.col)
        d = t.try_cast("double")
        return F.coalesce(t.try_cast("long"), F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d)))
    if fraction(x.type):
        return F.when(x.col >= 0, F.floor(x.col)).otherwise(F.ceil(x.col)).cast("long")
    return x.col.try_cast("long")


@register("tofloat", "todouble", "double", "cypher_convert.tofloat")
def _to_float(x: Arg) -> Column:
    if kind(x.type) in ("list", "map"):
        raise TypeFault("toFloat() takes no list or map")
    return x.col.try_cast("double")


@register("toboolean", "cypher_convert.toboolean")
def _to_boolean(x: Arg) -> Column:
    if kind(x.type) == "boolean":
        return x.col
    if kind(x.type) == "number":
        return x.col != 0
    low = F.lower(F.trim(x.col))
    return F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False))


@register("tostring", "to_string", "string", "to_str", "str", "cypher_convert.tostring")
def _to_string(x: Arg) -> Column:
    return V.text(x)


register("to_bool", "tobool")(lambda x: x.col.cast("boolean"))
for _n, _t in {
    "to_int8": "tinyint", "to_int16": "smallint", "to_int32": "int", "to_int64": "bigint", "to_serial": "bigint", "to_float": "float", "to_double": "double",
    "to_int128": "decimal(38,0)", "to_uint128": "decimal(38,0)", "to_uint64": "decimal(20,0)", "to_uint8": "smallint", "to_uint16": "int", "to_uint32": "bigint",
}.items():
    def _strict(x: Arg, t: str = _t, n: str = _n) -> Column:
        out = x.col.cast(t)
        top = {"to_uint8": 255, "to_uint16": 65535, "to_uint32": 4294967295}.get(n)
        if n.startswith("to_uint"):
            bad = out < 0 if top is None else (out < 0) | (out > top)
            out = F.when(bad, F.raise_error(F.lit(f"value out of range for {n[3:].upper()}")).cast(t)).otherwise(out)
        return out

    register(_n)(_strict)


@register("cast", "fn.arrow_cast")
def _cast(x: Arg, to: Arg) -> Column:
    t = spark_type(str(to.value))
    if isinstance(t, T.StringType):
        return V.text(x)
    if is_duration(t):
        return temporal.duration_of(x)
    return x.col.cast(t)


# --- temporal -------------------------------------------------------------------------------


def _one(*args: Arg) -> Arg | None:
    return args[0] if args else None


for _k in ("", ".realtime", ".statement", ".transaction"):
    register(f"date{_k}", f"cypher_temporal.date{_k}")(lambda *a: temporal.make_date(_one(*a)))
    register(f"datetime{_k}", f"cypher_temporal.datetime{_k}")(lambda *a: temporal.make_moment(_one(*a), True))
    register(f"localdatetime{_k}", f"cypher_temporal.localdatetime{_k}")(lambda *a: temporal.make_moment(_one(*a), False))
    register(f"localtime{_k}", f"time{_k}", f"cypher_temporal.localtime{_k}", f"cypher_temporal.time{_k}")(lambda *a: temporal.clock(_one(*a)))
register("timestamp")(lambda *a: temporal.make_moment(_one(*a), False))
register("to_date", "fn.to_date")(lambda x: x.col.try_cast("date"))
register("duration", "interval", "cypher_temporal.duration")(lambda x: temporal.duration_of(x))
for _u, _key in {"between": "all", "inmonths": "months", "indays": "days", "inseconds": "seconds"}.items():
    register(f"duration.{_u}", f"cypher_temporal.duration.{_u}")((lambda u: lambda a, b: temporal.between(u, a, b))(_key))
for _f, _out in {"date": "date", "datetime": "timestamp", "localdatetime": "timestamp_ntz"}.items():
    register(f"{_f}.truncate", f"cypher_temporal.{_f}.truncate")((lambda o: lambda u, x: temporal.truncate(u.value, x, o))(_out))
register("datetime.fromepoch", "cypher_temporal.datetime.fromepoch")(lambda s, n=None: F.timestamp_micros((s.col * 1_000_000 + (n.col / 1000 if n is not None else 0)).cast("long")))
register("datetime.fromepochmillis", "cypher_temporal.datetime.fromepochmillis")(lambda ms: F.timestamp_millis(ms.col))
register("date_trunc", "fn.date_trunc")(lambda u, x: F.date_trunc(u.value, x.col).cast(x.type if kind(x.type) == "date" else "timestamp_ntz"))


@register("date_part", "fn.date_part")
def _date_part(unit: Arg, x: Arg) -> Column:
    u = str(unit.value).lower()
    extra = {"decade": lambda c: F.floor(F.year(c) / 10), "century": lambda c: F.ceil(F.year(c) / 100), "millennium": lambda c: F.ceil(F.year(c) / 1000)}
    return (extra[u](x.col) if u in extra else F.extract(F.lit(u), x.col)).cast("long")


plain(lambda x: F.ceil(F.year(x) / 100).cast("long"), "century")
plain(lambda x: F.date_format(x, "EEEE"), "dayname")
plain(lambda x: F.date_format(x, "MMMM"), "monthname")
plain(F.last_day, "last_day")
plain(lambda y, m, d: F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int")).try_cast("date"), "make_date", "fn.make_date")
plain(lambda ms: F.timestamp_millis(ms).cast("timestamp_ntz"), "epoch_ms", "fn.to_timestamp_millis")
plain(lambda t: F.unix_millis(t.cast("timestamp")), "to_epoch_ms", "epochmillis")
plain(lambda s: F.timestamp_seconds(s).cast("timestamp_ntz"), "to_timestamp", "fn.to_timestamp_seconds", "fn.from_unixtime")
plain(lambda s: F.timestamp_micros(s).cast("timestamp_ntz"), "fn.to_timestamp_micros")
plain(lambda t: F.unix_seconds(t.cast("timestamp")), "fn.to_unixtime")
plain(lambda: F.current_date(), "current_date", "fn.current_date")
plain(lambda: F.current_timestamp(), "now", "fn.now", "current_timestamp")
_clock = lambda c: F.date_format(c, "HH:mm:ss.SSSSSS")
plain(lambda: _clock(F.current_timestamp()), "fn.current_time", "current_time")
plain(lambda h, m, s: F.when((h >= 0) & (h < 24) & (m >= 0) & (m < 60) & (s >= 0) & (s < 60), F.format_string("%02d:%02d:%02d", h.cast("int"), m.cast("int"), s.cast("int"))), "fn.make_time")
plain(lambda s: _clock(F.concat(F.lit("2000-01-01 "), s.cast("string")).try_cast("timestamp_ntz")), "fn.to_time")
plain(lambda s: s.try_cast("timestamp_ntz"), "fn.to_timestamp", "fn.to_local_time")
plain(lambda n: F.timestamp_micros(F.floor(n / 1000)).cast("timestamp_ntz"), "fn.to_timestamp_nanos")


@register("fn.date_bin")
def _date_bin(width: Arg, at: Arg, origin: Arg | None = None) -> Column:
    """The start of the bin of `width` (a duration of days and shorter parts) that `at` lies in."""
    w = width.col if is_duration(width.type) else temporal.duration_of(width)
    micros = (w.getField("days") * 86_400 + w.getField("seconds")) * 1_000_000 + F.floor(w.getField("nanos") / 1000)
    moment = lambda c: F.unix_micros(c.cast("timestamp"))
    zero = moment(origin.col) if origin is not None else F.lit(0).cast("long")
    off = F.pmod(moment(at.col) - zero, micros)
    return F.timestamp_micros(moment(at.col) - off).cast("timestamp_ntz")


register("fn.to_char")(lambda x, f: F.date_format(x.col, f.value))


@register("date_add")
def _date_add(unit: Arg, n: Arg, x: Arg) -> Column:
    part, factor = temporal.UNITS[str(unit.value).lower().rstrip("s") + "s"]
    return temporal.shift(x, temporal.duration(**{part: n.col * factor}), 1)


@register("date_diff", "datediff")
def _date_diff(*args: Arg) -> Column:
    if len(args) == 2:
        return F.datediff(args[0].col, args[1].col).cast("long")
    return F.timestamp_diff(str(args[0].value).upper(), temporal.moment(args[1]), temporal.moment(args[2])).cast("long")


for _n, (_p, _f) in temporal.UNITS.items():
    register(f"to_{_n}")((lambda p, f: lambda x: temporal.duration(**{p: x.col * f}))(_p, _f))

# --- JSON -----------------------------------------------------------------------------------

register("json.parse")(lambda x: F.to_json(F.parse_json(x.col)))
register("json.stringify")(lambda x: F.to_json(x.col) if isinstance(x.type, (T.StructType, T.ArrayType, T.MapType)) else x.col.cast("string"))
register("json.valid")(lambda x: F.when(x.col.isNotNull(), F.is_valid_utf8(x.col) & F.try_parse_json(x.col).isNotNull()))
register("json.query")(lambda d, p: jsonfns.query(d.col, p.value))
register("json.value")(lambda d, p: jsonfns.value(d.col, p.value))
register("json.exists")(lambda d, p: jsonfns.exists(d.col, p.value))
register("json.type")(lambda d: jsonfns.type_of(d.col))
register("json.keys")(lambda d: F.json_object_keys(d.col))
register("json.array_length")(lambda d: F.json_array_length(d.col).cast("long"))
register("json.elements")(lambda d: F.from_json(jsonfns.query(d.col, "$[*]"), "array<string>"))
register("json.entries")(lambda d: F.map_entries(F.from_json(d.col, "map<string,string>")))
register("json.object")(lambda *xs: F.to_json(F.struct(*(v.col.alias(k.value) for k, v in zip(xs[::2], xs[1::2], strict=True)))))
register("json.array")(lambda *xs: F.to_json(F.array(*(x.col for x in xs))))
for _m in ("set", "insert", "replace"):
    register(f"json.{_m}")((lambda m: lambda d, p, v: jsonfns.edit(m, d.col, p.value, v.col.cast("string")))(_m))
register("json.remove")(lambda d, p: jsonfns.edit("remove", d.col, p.value, None))
for _m in ("merge_patch", "equals", "contains"):
    register(f"json.{_m}")((lambda m: lambda a, b: jsonfns.pair(m, a.col, b.col))(_m))

#: Parameters by name, for calls that name their arguments.
PARAMETERS: dict[str, tuple[str, ...]] = {
    **dict.fromkeys(("substring",), ("s", "start", "length")),
    **dict.fromkeys(("substr", "fn.substr"), ("s", "position", "length")),
    **dict.fromkeys(("left", "right", "fn.left", "fn.right", "repeat", "fn.repeat"), ("s", "n")),
    **dict.fromkeys(("replace", "fn.replace"), ("s", "search", "replacement")),
    **dict.fromkeys(("split", "string_split", "str_split", "string_to_array"), ("s", "delimiter")),
    "split_part": ("s", "delimiter", "position"),
    **dict.fromkeys(("lpad", "rpad", "fn.lpad", "fn.rpad"), ("s", "length", "pad")),
    **dict.fromkeys(("trim", "btrim", "ltrim", "rtrim"), ("s", "characters")),
    **dict.fromkeys(("round", "fn.round"), ("x", "digits")),
    **dict.fromkeys(("range", "cypher_range"), ("start", "stop", "step")),
    **dict.fromkeys(("pow", "power", "fn.power"), ("base", "exponent")),
    **dict.fromkeys(("atan2", "fn.atan2"), ("y", "x")),
    **dict.fromkeys(("mod", "gcd", "lcm", "fn.gcd", "fn.lcm"), ("a", "b")),
    **dict.fromkeys(("contains", "starts_with", "ends_with", "startswith", "endswith", "prefix", "suffix"), ("s", "part")),
    **dict.fromkeys(("regexp_matches", "regexp_full_match", "regex_match", "fn.regexp_like"), ("s", "pattern")),
    **dict.fromkeys(("regexp_replace", "fn.regexp_replace"), ("s", "pattern", "replacement", "flags")),
    **dict.fromkeys(("regexp_extract", "regexp_extract_all"), ("s", "pattern", "group")),
    **dict.fromkeys(("list_append", "list_contains", "list_position", "array_append", "array_contains"), ("list", "value")),
    **dict.fromkeys(("list_slice", "array_slice"), ("list", "low", "high")),
    "make_date": ("year", "month", "day"),
    **dict.fromkeys(("date_part", "date_trunc"), ("unit", "at")),
    "date_add": ("unit", "n", "at"),
    "date_diff": ("unit", "start", "stop"),
    **dict.fromkeys(("json.value", "json.query", "json.exists", "json.remove"), ("json", "path")),
    **dict.fromkeys(("json.set", "json.insert", "json.replace"), ("json", "path", "value")),
    **dict.fromkeys(("vector.dot", "vector.cosine_similarity", "vector.l2_distance", "vector.maxsim"), ("a", "b")),
    "cast": ("value", "type"),
}

AGGREGATES = {
    "count", "sum", "avg", "min", "max", "collect", "stdev", "stdevp", "percentilecont", "percentiledisc", "count_if", "json.array_agg", "json.object_agg",
}


def build(name: str, args: list[Arg], extra: dict[str, Builder] | None = None) -> Column:
    fn = (extra or {}).get(name) or FUNCTIONS.get(name)
    if fn is None:
        raise SemanticFault(f"unknown function {name}()")
    try:
        return fn(*args)
    except TypeError as e:
        if "positional argument" in str(e):
            raise ArgumentFault(f"wrong number of arguments for {name}()") from e
        raise


__all__ = ["AGGREGATES", "FUNCTIONS", "Arg", "UnsupportedFault", "build", "numeric", "register"]
