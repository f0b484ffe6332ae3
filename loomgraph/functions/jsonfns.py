"""JSON functions over JSON text; what Spark's path functions cannot say goes through Arrow batches."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _load(text: Any) -> tuple[bool, Any]:
    try:
        return True, json.loads(text) if isinstance(text, str) else None
    except ValueError:
        return False, None


def _dump(value: Any) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


STEP = re.compile(r"\.\.|\.([\w$]+)|\.\*|\[\s*(-?\d+)\s*\]|\[\s*['\"](.*?)['\"]\s*\]|\[\s*\*\s*\]|\[\s*(-?\d*)\s*:\s*(-?\d*)\s*\]|\[\s*(-?\d+(?:\s*,\s*-?\d+)+)\s*\]|([\w$]+)|\*")


#: `[?(@.a.b > 2)]`, `[?(@.a)]`, and `["a", "b"]`.
FILTER = re.compile(r"\[\s*\?\s*\(\s*@((?:\.[\w$]+)*)\s*(?:(==|!=|<=|>=|<|>)\s*(.+?))?\s*\)\s*\]")
NAMES = re.compile(r"""\[\s*((?:"[^"]*"|'[^']*')(?:\s*,\s*(?:"[^"]*"|'[^']*'))+)\s*\]""")


def _passes(v: Any, keys: list[str], op: str | None, want: Any) -> bool:
    """Whether an element fulfils a filter; values of different kinds are never ordered."""
    for k in keys:
        if not isinstance(v, dict) or k not in v:
            return False
        v = v[k]
    if op is None:
        return True
    if op in ("==", "!="):
        return (kind_of(v) == kind_of(want) and v == want) == (op == "==")
    if kind_of(v) != kind_of(want) or kind_of(v) not in ("number", "string"):
        return False
    return {"<": v < want, "<=": v <= want, ">": v > want, ">=": v >= want}[op]


def steps(path: str) -> list[tuple[str, Any]]:
    """A path as steps; `$.a[0].b`, `$..a`, `[*]`, `[1:3]`, `[0,2]` and `/pointer/0` forms."""
    if path.startswith("/"):
        return [("any", p.replace("~1", "/").replace("~0", "~")) for p in path[1:].split("/")]
    out: list[tuple[str, Any]] = []
    at = 1 if path.startswith("$") else 0
    while at < len(path):
        if m := FILTER.match(path, at):
            literal = (m[3] or "null").strip()
            quoted = literal[:1] == "'" and literal[-1:] == "'"
            out.append(("filter", (m[1].split(".")[1:], m[2], literal[1:-1] if quoted else json.loads(literal))))
            at = m.end()
            continue
        if m := NAMES.match(path, at):
            out.append(("names", [x[1] or x[2] for x in re.finditer(r"""("([^"]*)"|'([^']*)')""", m[1]) for x in [(0, x[2], x[3])]]))
            at = m.end()
            continue
        m = STEP.match(path, at)
        if not m or m.end() == at:
            raise ValueError(f"bad path {path!r}")
        t = m.group()
        if t == "..":
            out.append(("deep", None))
        elif t in (".*", "*") or re.fullmatch(r"\[\s*\*\s*\]", t):
            out.append(("all", None))
        elif m[1] is not None or m[7] is not None:
            out.append(("key", m[1] or m[7]))
        elif m[2] is not None:
            out.append(("at", int(m[2])))
        elif m[3] is not None:
            out.append(("key", m[3]))
        elif m[6] is not None:
            out.append(("many", [int(x) for x in m[6].split(",")]))
        else:
            out.append(("range", (int(m[4]) if m[4] else None, int(m[5]) if m[5] else None)))
        at = m.end()
    return out


def walk(value: Any, path: list[tuple[str, Any]]) -> list[Any]:
    found = [value]
    for op, x in path:
        nxt: list[Any] = []
        for v in found:
            if op == "deep":
                stack = [v]
                while stack:
                    y = stack.pop(0)
                    nxt.append(y)
                    stack += list(y.values()) if isinstance(y, dict) else y if isinstance(y, list) else []
            elif op == "filter":
                nxt += [y for y in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else []) if _passes(y, *x)]
            elif op == "names":
                nxt += [v[k] for k in x if isinstance(v, dict) and k in v]
            elif op == "all":
                nxt += list(v.values()) if isinstance(v, dict) else v if isinstance(v, list) else []
            elif op == "any" and isinstance(v, list) and re.fullmatch(r"\d+", x):
                nxt += v[int(x) : int(x) + 1]
            elif op in ("key", "any") and isinstance(v, dict) and x in v:
                nxt.append(v[x])
            elif isinstance(v, list) and op == "at" and -len(v) <= x < len(v):
                nxt.append(v[x])
            elif isinstance(v, list) and op == "range":
                nxt += v[slice(*x)]
            elif isinstance(v, list) and op == "many":
                nxt += [v[i] for i in x if -len(v) <= i < len(v)]
        found = nxt
    return found


def _edit(value: Any, path: list[tuple[str, Any]], mode: str, new: Any) -> Any:
    if not path:
        return new
    (_, x), rest = path[0], path[1:]
    if isinstance(value, dict) and isinstance(x, str):
        out = dict(value)
        if rest:
            if x in out:
                out[x] = _edit(out[x], rest, mode, new)
        elif mode == "remove":
            out.pop(x, None)
        elif (x in out and mode in ("set", "replace")) or (x not in out and mode in ("set", "insert")):
            out[x] = new
        return out
    if isinstance(value, list) and str(x).lstrip("-").isdigit():
        out, i = list(value), int(x)
        if rest:
            if -len(out) <= i < len(out):
                out[i] = _edit(out[i], rest, mode, new)
        elif mode == "remove":
            out[i : i + 1] = []
        elif mode == "insert":
            out.insert(i, new)
        elif -len(out) <= i < len(out):
            out[i] = new
        elif mode == "set":
            out.append(new)
        return out
    return value


def merge_patch(a: Any, b: Any) -> Any:
    if not isinstance(b, dict):
        return b
    out = dict(a) if isinstance(a, dict) else {}
    for k, v in b.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge_patch(out.get(k), v)
    return out


def contains(a: Any, b: Any) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and contains(a[k], v) for k, v in b.items())
    if isinstance(a, list):
        return all(any(contains(x, y) for x in a) for y in (b if isinstance(b, list) else [b]))
    return type(a) is type(b) and a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and a == b)


def kind_of(v: Any) -> str:
    return "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def query(doc: Column, path: str) -> Column:
    """All values that a path finds, as a JSON array."""
    p = steps(path)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: _dump(walk(v, p)) if isinstance(t, str) and (got := _load(t))[0] and ((v := got[1]), True)[1] else None)

    return run(doc)


def value(doc: Column, path: str) -> Column:
    """The first scalar that a path finds, as text; null for JSON null, objects and arrays."""
    p = steps(path)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t: Any) -> str | None:
            ok, v = _load(t)
            got = walk(v, p) if ok and isinstance(t, str) else []
            if not got or isinstance(got[0], (dict, list)) or got[0] is None:
                return None
            return got[0] if isinstance(got[0], str) else _dump(got[0])

        return s.map(one)

    if re.fullmatch(r"\$(\.\w+|\[\d+\])+", path):  # the plain case stays in the JVM; only scalars are text there
        return F.when(F.is_variant_null(F.try_variant_get(F.try_parse_json(doc), path, "variant")), None).when(
            F.schema_of_variant(F.try_variant_get(F.try_parse_json(doc), path, "variant")).rlike("^(ARRAY|OBJECT)"), None
        ).otherwise(F.get_json_object(doc, path))
    return run(doc)


def exists(doc: Column, path: str) -> Column:
    return F.size(F.from_json(query(doc, path), "array<string>")) > 0


def edit(mode: str, doc: Column, path: str, new: Column | None) -> Column:
    p = steps(path)

    @F.pandas_udf("string")
    def run(s: pd.Series, n: pd.Series) -> pd.Series:
        def one(t: Any, raw: Any) -> str | None:
            ok, v = _load(t)
            if not ok or not isinstance(t, str):
                return None
            good, w = _load(raw)
            return _dump(_edit(v, p, mode, w if good else raw))

        return pd.Series([one(t, r) for t, r in zip(s, n, strict=True)])

    return run(doc, new if new is not None else F.lit(None).cast("string"))


def pair(name: str, a: Column, b: Column) -> Column:
    """merge_patch, equals or contains of two JSON texts."""
    fns = {"merge_patch": merge_patch, "equals": lambda x, y: contains(x, y) and contains(y, x), "contains": contains}
    fn = fns[name]

    @F.pandas_udf("string")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(s: Any, t: Any) -> str | None:
            (ok1, v), (ok2, w) = _load(s), _load(t)
            return _dump(fn(v, w)) if ok1 and ok2 and isinstance(s, str) and isinstance(t, str) else None

        return pd.Series([one(s, t) for s, t in zip(x, y, strict=True)])

    out = run(a, b)
    return out if name == "merge_patch" else out == "true"


def type_of(doc: Column) -> Column:
    t = F.schema_of_variant(F.try_parse_json(doc))
    return (
        F.when(t == "VOID", "null").when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object")
        .when(t == "BOOLEAN", "boolean").when(t == "STRING", "string").when(t.isNotNull(), "number")
    )
