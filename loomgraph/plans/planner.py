"""From syntax trees to lazy DataFrames.

A state is a DataFrame and a scope. Clauses transform states: patterns become joins, projections
become select or groupBy, subqueries become semi joins or grouped left joins on the keys that link
them to the outer row. Catalyst does the rest.
"""

from __future__ import annotations

import dataclasses
import itertools
from collections import Counter
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentFault, SemanticFault, TypeFault, UnsupportedFault
from ..functions import registry, temporal
from ..functions import values as V
from ..functions.registry import AGGREGATES
from ..functions.values import Arg
from ..sources.mapping import ComputedMapping, EdgeMapping, NodeMapping
from ..sources.types import fraction, is_duration, kind, numeric, whole
from . import ast as A
from . import parser
from .bindings import Binding, Node, Path, Rel, RelList, Value, col

#: Functions whose result holds no element, whatever they are given.
PLAIN = frozenset("size length id elementid type typeof label labels count sum avg min max exists is_trail is_acyclic reduce startnode endnode".split())
UNROLL = 8  # longest variable-length range that is unrolled without asking whether it has ended
STARTS, ENDS = frozenset(("startnode", "start_node", "edge_src")), frozenset(("endnode", "end_node", "edge_dst"))
_names = itertools.count()


def fresh(stem: str) -> str:
    return f"{stem}_{next(_names)}"


@dataclass
class State:
    df: DataFrame | None
    scope: dict[str, Binding] = field(default_factory=dict)
    #: sort keys of a preceding ORDER BY: what collect() keeps
    order: list[tuple[str, bool]] = field(default_factory=list)
    #: hidden columns that identify the outer row of a correlated subquery
    corr: list[str] = field(default_factory=list)
    #: the distinct outer rows of a correlated subquery
    outer: DataFrame | None = None


@dataclass
class Tally:
    """A run of MATCHes whose rows are only counted by the projection that follows.

    Before a hop, rows that agree in all that is still read become one row with a weight, so no
    plan makes the pairs (or longer combinations) that a count sums up.
    """

    run: list[A.Match]
    #: variables that the projection reads
    reads: set[str]
    #: the column that says how many rows a row stands for; None while each is one
    weight: str | None = None
    #: names of which no two rows have the same node
    unique: set[str] = field(default_factory=set)
    #: conditions that were applied before the rest of their WHERE
    done: set[str] = field(default_factory=set)
    #: nodes whose keys may not be null
    solid: set[str] = field(default_factory=set)

    def later(self, m: A.Match) -> set[str]:
        """Variables read after this MATCH."""
        rest = self.run[next(i for i, x in enumerate(self.run) if x is m) + 1 :]
        return self.reads.union(*(variables(i) for x in rest for p in x.parts for i in p.items), *(variables(x.where) for x in rest if x.where is not None))


@dataclass
class Env:
    """Where an expression is compiled: scope, lambda variables and replaced subtrees."""

    df: DataFrame | None
    scope: dict[str, Binding]
    locals: dict[str, tuple[Column, T.DataType]] = field(default_factory=dict)
    swap: dict[str, tuple[Column, T.DataType]] = field(default_factory=dict)

    def bind(self, **more: tuple[Column, T.DataType]) -> Env:
        return Env(self.df, self.scope, self.locals | more, self.swap)


def joint(a: T.DataType | None, b: T.DataType) -> T.DataType:
    """One type for a property that several tables have."""
    if a is None or a == b:
        return b
    if numeric(a) and numeric(b):
        return T.LongType() if whole(a) and whole(b) else T.DoubleType()
    return T.StringType()


def conjuncts(e: A.Expr | None) -> list[A.Expr]:
    if e is None:
        return []
    return [*conjuncts(e.left), *conjuncts(e.right)] if isinstance(e, A.Bin) and e.op == "AND" else [e]


def children(e: Any) -> list[Any]:
    out = []
    if isinstance(e, (tuple, list)):
        for x in e:
            out += [x] if isinstance(x, A.Expr) else children(x)
    elif hasattr(e, "__dataclass_fields__"):
        for f in e.__dataclass_fields__:
            v = getattr(e, f)
            out += [v] if isinstance(v, A.Expr) else children(v)
    return out


def variables(e: Any) -> set[str]:
    """Free variable names of an expression (an over-estimate where inner names hide outer ones)."""
    if isinstance(e, A.Var):
        return {e.name}
    if isinstance(e, (A.ListComp, A.Quant)):
        inner = set().union(*(variables(x) for x in (e.where, getattr(e, "out", None)) if x is not None), set())
        return variables(e.source) | (inner - {e.var})
    if isinstance(e, A.Reduce):
        return variables(e.init) | variables(e.source) | (variables(e.body) - {e.acc, e.var})
    if isinstance(e, A.Lambda):
        return variables(e.body) - set(e.params)
    if isinstance(e, (A.NodePat, A.RelPat)) and e.var:
        return {e.var}.union(*(variables(c) for c in children(e)), set())
    if isinstance(e, (A.Sub, A.PatternComp)):
        names: set[str] = set()
        for p in e.parts if isinstance(e, A.Sub) else (e.part,):
            for i in p.items:
                names |= variables(i)
        return names.union(*(variables(c) for c in children(e)), set())
    return set().union(*(variables(c) for c in children(e)), set())


def is_aggregate(e: Any) -> bool:
    """Built-in aggregates, and declared ones, whose names begin with `agg.`."""
    return isinstance(e, A.Func) and (e.name in AGGREGATES or e.name.startswith("agg."))


#: Aggregates that can be worked out from weighted rows.
COUNTED = frozenset(("count", "min", "max"))


def renamed(e: Any, names: dict[str, str]) -> Any:
    """A pattern or expression with other variable names."""
    if isinstance(e, tuple):
        return tuple(renamed(x, names) for x in e)
    if isinstance(e, A.Var):
        return A.Var(names.get(e.name, e.name))
    if not dataclasses.is_dataclass(e):
        return e
    if isinstance(e, (A.NodePat, A.RelPat)):
        e = dataclasses.replace(e, var=names.get(e.var, e.var))
        return dataclasses.replace(e, props=renamed(e.props, names))
    return dataclasses.replace(e, **{f: renamed(getattr(e, f), names) for f in e.__dataclass_fields__})


def aggregated(e: Any) -> bool:
    if is_aggregate(e):
        return True
    return not isinstance(e, A.Sub) and any(aggregated(c) for c in children(e))


class Planner:
    def __init__(self, graph: Any, params: dict[str, Any]):
        self.graph, self.params, self.spark = graph, params, graph.spark
        self.used: dict[str, set[str]] = {}
        #: property names read anywhere, and whether whole elements may be returned: what path values carry
        self.keys: set[str] = set()
        self.whole = False
        self.fields: dict[str, T.DataType] = {}
        #: of the last hop: "one" if each row met one far node at most, "many" if each far node met one row at most
        self.fan: str | None = None
        #: paths of which no relationship's identity is read
        self.plain: set[str] = set()

    # === queries ===========================================================================

    def run(self, q: A.Query) -> DataFrame:
        self._demand(q)
        self.plain = self.plain_paths(q)
        return self.query(q, State(None)).df

    def plain_paths(self, q: A.Query) -> set[str]:
        """Paths that are read for nodes, lengths, and properties and types of relationships alone.

        Where a table declares no identity, all of its columns are one: then a path that nobody compares
        or returns should not carry it.
        """
        steps, named, read, fine = ("relationships", "rels", "cypher_relationships"), set(), Counter(), Counter()

        def path(e: Any, functions: tuple[str, ...]) -> str | None:
            ok = isinstance(e, A.Func) and e.name in functions and len(e.args) == 1 and isinstance(e.args[0], A.Var)
            return e.args[0].name if ok else None

        def uses(e: Any, var: str) -> bool:
            """Whether `var` is read for properties and types only."""
            if isinstance(e, A.Var):
                return e.name != var
            if isinstance(e, A.Prop) and isinstance(e.owner, A.Var):
                return e.owner.name != var or not e.key.startswith("_")
            if isinstance(e, A.Func) and e.name == "type" and len(e.args) == 1 and isinstance(e.args[0], A.Var):
                return True
            return not isinstance(e, (A.Sub, A.PatternComp)) and all(uses(c, var) for c in children(e))

        def visit(e: Any) -> None:
            if isinstance(e, A.Part) and e.path:
                named.add(e.path)
            if isinstance(e, A.Var):
                read[e.name] += 1
            p = path(e, ("nodes", "cypher_nodes", "length"))
            if isinstance(e, A.Func) and e.name in ("size", "length", "type") and len(e.args) == 1:
                inner = e.args[0]
                p = p or path(inner.owner if e.name == "type" and isinstance(inner, A.Index) else inner if e.name != "type" else None, steps)
            if isinstance(e, A.Prop) and isinstance(e.owner, A.Index) and not e.key.startswith("_"):
                p = path(e.owner.owner, steps)
            if isinstance(e, A.ListComp) and e.out is not None and uses(e.out, e.var) and (e.where is None or uses(e.where, e.var)):
                p = path(e.source, steps)
            if p is not None:
                fine[p] += 1
            if isinstance(e, (tuple, list)):
                for x in e:
                    visit(x)
            elif hasattr(e, "__dataclass_fields__"):
                for f in e.__dataclass_fields__:
                    visit(getattr(e, f))

        visit(q)
        return set() if "*" in self.used else {p for p in named if read[p] == fine[p]}

    def query(self, q: A.Query, start: State) -> State:
        states = [self.single(s, start) for s in q.parts]
        out = states[0]
        for s, all_ in zip(states[1:], q.all, strict=True):
            if set(s.scope) != set(out.scope):
                raise SemanticFault("all parts of a UNION need the same column names")
            names = list(out.scope)
            corr = start.corr
            left = out.df.select(*corr, *(self._return_col(out, n) for n in names))
            right = s.df.select(*corr, *(self._return_col(s, n) for n in names))
            df = left.unionByName(right)
            df = df if all_ else df.distinct()
            out = State(df, {n: Value(n, df.schema[n].dataType) for n in names}, [], corr, start.outer)
        return out

    def _return_col(self, s: State, name: str) -> Column:
        return self.value_of(s.scope[name]).alias(name)

    def single(self, s: A.Single, start: State) -> State:
        state = State(start.df, dict(start.scope), list(start.order), list(start.corr), start.outer)
        tally: Tally | None = None
        for i, c in enumerate(s.clauses):
            last = i == len(s.clauses) - 1
            if isinstance(c, A.Match):
                if i == 0 or not isinstance(s.clauses[i - 1], A.Match):
                    first, tally = i, self.tallying(s.clauses[i:], state)
                state = self.match(tally.run[i - first] if tally else c, state, tally)
            elif isinstance(c, A.Unwind):
                state = self.unwind(c, state)
            elif isinstance(c, (A.With, A.Return)):
                state = self.project(c.body, state, isinstance(c, A.Return), tally.weight if tally else None)
                tally = None
            elif isinstance(c, A.CallSub):
                state = self.call_sub(c, state)
            elif isinstance(c, A.CallProc):
                state = self.call_proc(c, state)
            else:
                state = self.graph.writer(self).apply(c, state)
            if last and not isinstance(c, A.Return) and not (isinstance(c, A.CallProc) and c.standalone):
                if isinstance(c, (A.Match, A.With, A.Unwind)):
                    raise SemanticFault("a query cannot end here; RETURN is missing")
        return state

    def base(self, state: State) -> DataFrame:
        return state.df if state.df is not None else self.spark.range(1).select()

    def _demand(self, q: Any) -> None:
        """Which properties of each name are read; '*' where a whole value is."""

        def visit(e: Any) -> None:
            if isinstance(e, A.Prop):
                self.keys.add(e.key)
            if isinstance(e, A.Index):
                if isinstance(e.at, A.Lit) and isinstance(e.at.value, str):
                    self.keys.add(e.at.value)
                elif not isinstance(e.at, A.Lit):
                    self.whole = True
            if isinstance(e, A.Func) and e.name in ("properties", "property_map", "keys"):
                self.whole = True
            if isinstance(e, A.Projection) and (e.star or any(self._carries(i.expr) for i in e.items)):
                self.whole = True
            if isinstance(e, A.Prop) and isinstance(e.owner, A.Var):
                self.used.setdefault(e.owner.name, set()).add(e.key)
                return
            if isinstance(e, A.Func) and e.name in ("id", "count", "type", "labels", "label") and len(e.args) == 1 and isinstance(e.args[0], A.Var):
                self.used.setdefault(e.args[0].name, set())
                return
            if isinstance(e, A.Var):
                self.used.setdefault(e.name, set()).add("*")
                return
            if isinstance(e, A.Projection) and e.star:
                self.used["*"] = {"*"}
            if isinstance(e, (A.NodePat, A.RelPat)) and e.var:
                self.used.setdefault(e.var, set()).update(k for k, _ in e.props)
            if isinstance(e, A.Part) and e.path:
                for i in e.items:
                    if i.var:
                        self.used.setdefault(i.var, set()).add("*")
            if isinstance(e, (tuple, list)):
                for x in e:
                    visit(x)
            elif hasattr(e, "__dataclass_fields__"):
                for f in e.__dataclass_fields__:
                    visit(getattr(e, f))

        visit(q)

    def _carries(self, e: Any) -> bool:
        """Whether the value of an expression may hold a whole node, relationship or path."""
        if isinstance(e, A.Var):
            return True
        if isinstance(e, A.Func):
            return e.name not in PLAIN and any(self._carries(a) for a in e.args)
        if isinstance(e, (A.Index, A.Slice)):
            return self._carries(e.owner)
        if isinstance(e, A.ListComp):
            return self._carries(e.source if e.out is None else e.out)
        if isinstance(e, (A.ListLit, A.MapLit, A.Case)):
            return any(self._carries(c) for c in children(e))
        return isinstance(e, A.Bin) and e.op == "+" and (self._carries(e.left) or self._carries(e.right))

    def wanted(self, var: str | None, in_path: bool = False) -> bool:
        return in_path or "*" in self.used or (var is not None and bool(self.used.get(var)))

    # === scans =============================================================================

    def candidates(self, labels: Any) -> tuple[NodeMapping, ...]:
        def holds(tree: Any, m: NodeMapping) -> bool:
            op, x = tree
            if op == "is":
                return x in m.labels
            if op == "tag":
                return x == m.tag
            if op == "not":
                return not holds(x, m)
            return (all if op == "and" else any)(holds(t, m) for t in x)

        return tuple(m for m in self.graph.nodes if labels is None or holds(labels, m))

    def _key(self, columns: tuple[str, ...], as_text: bool) -> Column:
        c = col(columns[0]) if len(columns) == 1 else F.struct(*(col(x).alias(f"k{i}") for i, x in enumerate(columns)))
        return c.cast("string") if as_text else c

    def node_scan(self, mappings: tuple[NodeMapping, ...]) -> tuple[DataFrame, Node]:
        stem = fresh("n")
        types: dict[str, T.DataType] = {}
        text_key = self._text_keys(mappings)
        frames = []
        node = Node(f"{stem}_k", f"{stem}_l", mappings)
        for m in mappings:
            df = self.graph.rows(m)
            cols = [self._key(m.key, text_key).alias(node.key), F.lit(m.tag).alias(node.label)]
            for p, c in m.properties.items():
                cols.append(col(c).alias(f"{stem}_p_{p}"))
                types.setdefault(p, df.schema[c].dataType)
            for i, e in enumerate(self.graph.edges):
                if isinstance(e, EdgeMapping) and len(mappings) == 1 and self._home(e) == m.tag and e.table == m.table:
                    other = e.target_key if self._source_home(e) else e.source_key
                    cols.append(self._key(other, False).alias(f"{stem}_f_{i}"))
                    node.held[i] = f"{stem}_f_{i}"
            frames.append(df.select(*cols))
        if not frames:
            df = self.spark.range(0).select(F.lit(None).cast("long").alias(node.key), F.lit("").alias(node.label))
        else:
            df = frames[0]
            for f in frames[1:]:
                df = df.unionByName(f, allowMissingColumns=True)
        for p in types:
            node.props[p] = (f"{stem}_p_{p}", df.schema[f"{stem}_p_{p}"].dataType)
        return df, node

    def _text_keys(self, mappings: tuple[NodeMapping, ...]) -> bool:
        kinds = {self.graph.key_kind(m, self) for m in mappings}
        return len(kinds) > 1 and not kinds <= {"LongType()", "IntegerType()", "ShortType()", "ByteType()"}

    def _source_home(self, e: EdgeMapping) -> bool:
        return not e.collection and any(m.tag == e.source and m.table == e.table and m.key == e.source_key and not m.collection for m in self.graph.nodes)

    def _home(self, e: EdgeMapping) -> str | None:
        """The label whose own table holds this edge as a foreign key."""
        if e.query or e.where or e.collection:
            return None
        if self._source_home(e):
            return e.source
        if any(m.tag == e.target and m.table == e.table and m.key == e.target_key and not m.collection for m in self.graph.nodes):
            return e.target
        return None

    def edge_scan(self, rel: A.RelPat, sources: set[str] | None, targets: set[str] | None, text: tuple[bool, bool]) -> tuple[DataFrame, Rel] | None:
        """All relationships of the wanted types from `sources` to `targets` labels."""
        stem = fresh("r")
        r = Rel(f"{stem}_t", f"{stem}_i", f"{stem}_a", f"{stem}_b", rel.types, {}, (f"{stem}_al", f"{stem}_bl"), set())
        frames, types = [], {}
        for e in self.graph.edges:
            if rel.types and e.type not in rel.types:
                continue
            if (sources is not None and e.source not in sources) or (targets is not None and e.target not in targets):
                continue
            df, a, b, ident, props = self.graph.edge_rows(e, self)
            a, b = (x.cast("string") if t else x for x, t in zip((a, b), text, strict=True))
            cols = [F.lit(e.type).alias(r.type), self.identity(e, ident, not self._plain_ids(rel)).alias(r.id), a.alias(r.source), b.alias(r.target), F.lit(e.source).alias(r.ends[0]), F.lit(e.target).alias(r.ends[1])]
            for p, c in props.items():
                cols.append(c.alias(f"{stem}_p_{p}"))
                types[p] = None
            r.homes.add(self.home_of(e))
            frames.append(df.select(*cols).where(col(r.source).isNotNull() & col(r.target).isNotNull()))
        if not frames:
            return None
        df = frames[0]
        for f in frames[1:]:
            df = df.unionByName(f, allowMissingColumns=True)
        for p in types:
            r.props[p] = (f"{stem}_p_{p}", df.schema[f"{stem}_p_{p}"].dataType)
        return df, r

    def identity(self, e: Any, ident: Column, text: bool) -> Column:
        """What tells a relationship from all others of its type: where several tables hold the type, the
        table is part of it, whatever pattern asks."""
        if sum(x.type == e.type for x in self.graph.edges) > 1:
            return F.concat_ws("|", F.lit(e.table if isinstance(e, EdgeMapping) else e.type), F.lit(e.source), F.lit(e.target), ident.cast("string"))
        return ident.cast("string") if text else ident

    def _plain_ids(self, rel: A.RelPat) -> bool:
        return sum(1 for e in self.graph.edges if not rel.types or e.type in rel.types) == 1

    # === MATCH =============================================================================

    def match(self, m: A.Match, state: State, tally: Tally | None = None) -> State:
        if not m.optional:
            state = self.pattern(m.parts, state, m.where, m, tally)
            return self.filtered(state, m.where, tally.done if tally else set())
        return self.optional(m, state)

    def filtered(self, state: State, where: A.Expr | None, done: set[str] = frozenset()) -> State:
        for c in conjuncts(where):
            if repr(c) not in done:
                state = self.condition(c, state)
        return state

    # --- patterns that are only counted ----------------------------------------------------

    def tallying(self, clauses: tuple[Any, ...], state: State) -> Tally | None:
        """For MATCHes followed by a projection that counts: how their rows may be put together."""
        run = list(itertools.takewhile(lambda c: isinstance(c, A.Match), clauses))
        after = clauses[len(run)] if len(run) < len(clauses) else None
        if not isinstance(after, (A.With, A.Return)) or after.body.star or state.corr or any(m.optional for m in run):
            return None
        exprs = [*(i.expr for i in after.body.items), *(o.expr for o in after.body.order)]
        every = [x for e in exprs for x in self._all(e)]
        if not any(aggregated(e) for e in exprs) or any(isinstance(x, (A.Sub, A.PatternComp)) or (is_aggregate(x) and x.name not in COUNTED) for x in every):
            return None
        parts = [p for m in run for p in m.parts]
        if any(p.path or p.selector or any(isinstance(i, A.RelPat) and (i.variable or i.mode) for i in p.items) for p in parts):
            return None
        tally = Tally([], set().union(*(variables(e) for e in exprs), set()))
        tally.run = [self.inlined(m, tally) for m in run]
        return tally

    def inlined(self, m: A.Match, tally: Tally) -> A.Match:
        """One relationship that a plain Cypher pattern makes is replaced by that pattern."""
        rels = [i for p in m.parts for i in p.items if isinstance(i, A.RelPat)]
        for k, p in enumerate(m.parts):
            for i in range(1, len(p.items), 2):
                got = self._inline(p.items[i], p.items[i - 1], p.items[i + 1], rels)
                if got is not None:
                    chain, where = got
                    tally.solid |= {chain[0].var, chain[-1].var}
                    self._demand((chain, where))
                    new = A.Part(None, (*p.items[: i - 1], *chain, *p.items[i + 2 :]))
                    both = where if m.where is None else m.where if where is None else A.Bin("AND", m.where, where)
                    return A.Match((*m.parts[:k], new, *m.parts[k + 1 :]), both, False)
        return m

    def _inline(self, rel: A.RelPat, left: A.NodePat, right: A.NodePat, rels: list[A.RelPat]) -> tuple[tuple[Any, ...], A.Expr | None] | None:
        """The pattern behind a relationship, from `left` to `right`; None where it is more than one chain of
        nodes, keeps other rows than its pattern, or its relationships could meet others of the same MATCH."""
        fits = [e for e in self.graph.edges if e.type in rel.types]
        e = fits[0] if len(fits) == 1 else None
        if not isinstance(e, ComputedMapping) or e.kind != "cypher" or e.options.get("parameters") or rel.var or rel.props or rel.direction == "both":
            return None
        q = parser.parse(e.options["query"])
        if len(q.parts) != 1 or len(q.parts[0].clauses) != 2:
            return None
        inner, ret = q.parts[0].clauses
        if not isinstance(inner, A.Match) or inner.optional or len(inner.parts) != 1 or not isinstance(ret, A.Return):
            return None
        b, chain = ret.body, inner.parts[0]
        if b.distinct or b.star or b.order or b.skip is not None or b.limit is not None or any(aggregated(i.expr) for i in b.items):
            return None
        hops = chain.items[1::2]
        if chain.path or chain.selector or any(r.variable or r.mode for r in hops):
            return None
        if any(isinstance(x, (A.Sub, A.PatternComp, A.ListComp, A.Quant, A.Reduce, A.Lambda)) for x in self._all((chain.items, inner.where))):
            return None
        names = [i.var for i in chain.items if i.var]
        ends = {i.name: i.expr for i in b.items}
        tips = {}
        for side, tag in (("source", e.source), ("target", e.target)):
            x, home = ends.get(side), self.graph.mapping.node(tag)
            if not isinstance(x, A.Prop) or not isinstance(x.owner, A.Var) or len(home.key) != 1 or home.properties.get(x.key) != home.key[0]:
                return None
            at = [i for i in (chain.items[0], chain.items[-1]) if i.var == x.owner.name]
            if len(at) != 1 or self.candidates(at[0].labels) != (home,):
                return None
            tips[side] = at[0]
        if len(set(names)) != len(names) or tips["source"] is tips["target"]:
            return None
        others = [r for r in rels if r is not rel]
        if any(not r.types or e.type in r.types or any(not h.types or set(h.types) & set(r.types) for h in hops) for r in others):
            return None
        # a relationship of another computed type may hide one of these
        if any(isinstance(x, ComputedMapping) and x.kind == "cypher" for r in others for x in self.graph.edges if x.type in r.types):
            return None
        if self.graph.policy is not None:
            self.graph.policy.may_query(e.options["query"])
        near, far = ("source", "target") if rel.direction == "out" else ("target", "source")
        swap = {n: fresh(n) for n in names} | {tips[near].var: left.var or fresh("in"), tips[far].var: right.var or fresh("in")}
        items = list(renamed(chain.items, swap))
        if chain.items[0] is not tips[near]:
            items = [dataclasses.replace(i, direction={"out": "in", "in": "out"}.get(i.direction, i.direction)) if isinstance(i, A.RelPat) else i for i in reversed(items)]
        for k, outer, tag in ((0, left, e.source if near == "source" else e.target), (-1, right, e.target if far == "target" else e.source)):
            labels = ("tag", tag) if outer.labels is None else ("and", (outer.labels, ("tag", tag)))
            items[k] = A.NodePat(items[k].var, labels, (*outer.props, *items[k].props))
        return tuple(items), renamed(inner.where, swap)

    def rel_homes(self, rel: A.RelPat, left: A.NodePat, right: A.NodePat, scope: dict[str, Binding]) -> set[tuple[str, str, str, str]]:
        """What the identities of a pattern's relationships begin with."""
        def tags(n: A.NodePat) -> set[str]:
            b = scope.get(n.var)
            return {m.tag for m in (b.mappings if isinstance(b, Node) else self.candidates(n.labels))}

        a, b = tags(left), tags(right)
        ways = {"out": [(a, b)], "in": [(b, a)], "both": [(a, b), (b, a)]}[rel.direction]
        return {self.home_of(e) for e in self.graph.edges if (not rel.types or e.type in rel.types) and any(e.source in x and e.target in y for x, y in ways)}

    def home_of(self, e: Any) -> tuple[str, str, str, str]:
        return e.type, e.table if isinstance(e, EdgeMapping) else e.type, e.source, e.target

    def put_together(self, tally: Tally, m: A.Match, at: str, walk: list[tuple[A.RelPat, A.NodePat, A.NodePat]], needed: set[str], df: DataFrame, scope: dict[str, Binding], rels: list, state: State):
        """Before a hop from `at`: rows that agree in what is still needed become one."""
        for c in conjuncts(m.where):
            if repr(c) not in tally.done and variables(c) and variables(c) <= set(scope):
                df = self.condition(c, State(df, scope)).df
                tally.done.add(repr(c))
        needed = needed.union({at}, *(variables(c) for c in conjuncts(m.where) if repr(c) not in tally.done))
        kept = {n: b for n, b in scope.items() if n in needed}
        if len(kept) == len(scope) or tally.unique & set(kept) or any(isinstance(b, (Path, RelList)) for b in kept.values()):
            return df, scope
        ahead = set().union(*(self.rel_homes(*w, scope) for w in walk), set())
        if any(r.homes is None or r.homes & ahead for r, _ in rels):
            return df, scope
        everything = "*" in self.used
        new: dict[str, Binding] = {}
        for n, b in kept.items():
            read = self.used.get(n, set())
            if not isinstance(b, Value) and not everything and "*" not in read:
                b = dataclasses.replace(b, props={p: c for p, c in b.props.items() if p in read})
            new[n] = b
        columns = list(dict.fromkeys(c for b in new.values() for c in b.columns()))
        if any(isinstance(df.schema[c].dataType, (T.MapType, T.VariantType)) for c in columns):
            return df, scope
        name = fresh("w")
        df = df.groupBy(*(col(c) for c in columns)).agg((F.count(F.lit(1)) if tally.weight is None else F.sum(col(tally.weight))).alias(name))
        tally.weight, tally.unique = name, {at} if set(kept) == {at} else set()
        rels.clear()
        return df, new

    def degree(self, rel: A.RelPat, target: A.NodePat, names: list[str], flipped: bool, alone: bool, needed: set[str], df: DataFrame, scope: dict[str, Binding], tally: Tally) -> DataFrame | None:
        """A hop over a predicate whose far node is only counted: the number of far nodes becomes a weight."""
        from ..operators import computed

        e, here = self.predicate(rel), scope[names[0]]
        if e is None or rel.direction == "both" or rel.props or target.props or not alone or not isinstance(here, Node) or not here.single:
            return None
        turned = (rel.direction == "in") != flipped
        near, far = (e.target, e.source) if turned else (e.source, e.target)
        goal = {m.tag for m in self.candidates(target.labels)}
        if names[2] in scope or {names[1], names[2]} & needed or here.mappings[0].tag != near or far not in goal:
            return None
        found = computed.degrees(self.graph, e, turned)
        if found is None:
            return None
        k, n, w = fresh("k"), fresh("n"), fresh("w")
        df = df.join(found.select(col("_k").alias(k), col("_n").alias(n)), col(here.key) == col(k))
        df = df.withColumn(w, col(n) if tally.weight is None else col(n) * col(tally.weight))
        tally.weight = w
        return df

    def predicate(self, rel: A.RelPat) -> ComputedMapping | None:
        fits = [e for e in self.graph.edges if e.type in rel.types]
        return fits[0] if len(fits) == 1 and isinstance(fits[0], ComputedMapping) and fits[0].kind == "predicate" else None

    def condition(self, c: A.Expr, state: State) -> State:
        negated = isinstance(c, A.Un) and c.op == "NOT" and isinstance(c.arg, A.Sub) and c.arg.kind == "exists"
        sub = c.arg if negated else c
        if isinstance(sub, A.Sub) and sub.kind == "exists" and sub.query is None and state.df is not None:
            linked = self.linked(sub.parts, sub.where, state)
            if linked is not None:
                inner, on = linked
                return State(state.df.join(inner.df, on, "left_anti" if negated else "left_semi"), state.scope, state.order, state.corr, state.outer)
        state, env = self.prepared(state, [c])
        arg = self.arg(c, env)
        if kind(arg.type) not in ("boolean", "null"):
            raise TypeFault("WHERE needs a boolean")
        return State(self.base(state).where(arg.col.cast("boolean")), state.scope, state.order, state.corr, state.outer)

    def pattern(self, parts: tuple[A.Part, ...], state: State, where: A.Expr | None = None, m: A.Match | None = None, tally: Tally | None = None) -> State:
        """Join the parts to the state; relationships of one MATCH differ from each other."""
        scope, df = dict(state.scope), state.df
        rels: list[tuple[Rel | RelList, A.RelPat]] = []
        for part in parts:
            for i in part.items:
                if i.var and i.var in state.scope and isinstance(i, A.RelPat) and i.variable:
                    raise SemanticFault(f"{i.var!r} is already bound")
        for k, part in enumerate(parts):
            df, scope = self.part(part, df, scope, rels, state, where, tally and (tally, m, parts[k + 1 :]))
        out = State(df, scope, state.order, state.corr, state.outer)
        return out

    def part(self, part: A.Part, df: DataFrame | None, scope: dict[str, Binding], rels: list, state: State, where: A.Expr | None = None, counted: tuple[Tally, A.Match, tuple[A.Part, ...]] | None = None):
        items = list(part.items)
        bound = [i for i in range(0, len(items), 2) if items[i].var and items[i].var in scope]
        names: list[str | None] = [i.var for i in items]
        in_path = part.path is not None
        if any(isinstance(i, A.RelPat) and i.mode in ("SHORTEST", "ALL SHORTEST") for i in items):
            if len(items) != 3 or part.selector:
                raise UnsupportedFault("SHORTEST needs a pattern of one relationship")
            part = A.Part(part.path, part.items, "shortest" if items[1].mode == "SHORTEST" else "all_shortest")
        self.fields = self.path_fields(part, scope) if in_path else {}
        if part.selector:
            return self.shortest(part, df, scope, state, where)
        start = bound[0] if bound else 0
        for i, item in enumerate(items):
            if names[i] is None:
                names[i] = fresh(" anon")
        if counted and not bound:
            start = self.best_start(items, names, counted)
        alone = df is None
        df, scope = self.node(items[start], names[start], df, scope, state, in_path)
        if counted and not bound:
            counted[0].unique = {names[start]} if alone else set()
        df = self.solid(names[start], df, scope, counted)
        steps = [(i, i + 1, i + 2, False) for i in range(start, len(items) - 1, 2)] + [(i, i - 1, i - 2, True) for i in range(start, 0, -2)]
        for k, (a, r, b, flipped) in enumerate(steps):
            three = [names[a], names[r], names[b]]
            if counted:
                tally, m, after = counted
                walk = [(items[y], items[min(x, z)], items[max(x, z)]) for x, y, z, _ in steps[k:]]
                walk += [(p.items[y], p.items[y - 1], p.items[y + 1]) for p in after for y in range(1, len(p.items), 2)]
                rest = tally.later(m).union(*(variables(i) for p in after for i in p.items), *(variables(items[z].props) for s in steps[k:] for z in s[1:3]))
                ends = {names[z] for s in steps[k:] for z in s[:3]}
                df, scope = self.put_together(tally, m, three[0], walk, rest | ends, df, scope, rels, state)
                only = not any(p is not items[r] and (not p.types or set(p.types) & set(items[r].types)) for q in m.parts for p in q.items if isinstance(p, A.RelPat))
                beyond = rest.union({names[z] for s in steps[k + 1 :] for z in s[:3]}, *(variables(c) for c in conjuncts(where)))
                got = self.degree(items[r], items[b], three, flipped, only, beyond, df, scope, tally)
                if got is not None:
                    df = got
                    continue
            self.fan = None
            alone_said = lambda n: any(variables(c) == {n} and not any(isinstance(x, (A.Sub, A.PatternComp)) for x in self._all(c)) for c in conjuncts(where))
            sharp = len(scope) == 1 and not items[a].props and not alone_said(three[0]) and alone_said(three[2])
            df, scope = self.hop(items[r], items[b], three, flipped, df, scope, rels, state, in_path, where if sharp else None)
            df = self.solid(names[b], df, scope, counted)
            if counted and self.fan != "one":
                counted[0].unique = {names[b]} if self.fan == "many" and names[a] in counted[0].unique else set()
        if part.path:
            if part.path in scope:
                raise SemanticFault(f"{part.path!r} is already bound")
            scope = scope | {part.path: Path(tuple(n for n in names), self.fields, part.path in self.plain)}
        return df, scope

    def best_start(self, items: list[Any], names: list[str], counted: tuple[Tally, A.Match, tuple[A.Part, ...]]) -> int:
        """Which end of a counted pattern comes first: one that nothing reads, so that it is soon put together
        with others; over a predicate the one that is read, as the other becomes a number."""
        tally, m, after = counted
        read = tally.later(m).union(*(variables(i) for p in after for i in p.items), *(variables(c) for c in conjuncts(m.where)))
        first, last = names[0] in read, names[-1] in read
        if len(items) == 3 and self.predicate(items[1]) is not None:
            return 2 if last and not first else 0
        return len(items) - 1 if len(items) > 3 and first and not last else 0

    def solid(self, name: str, df: DataFrame, scope: dict[str, Binding], counted: tuple[Tally, A.Match, tuple[A.Part, ...]] | None) -> DataFrame:
        return df.where(col(scope[name].key).isNotNull()) if counted and name in counted[0].solid and name in scope else df

    def involved(self, rel: A.RelPat) -> tuple[NodeMapping, ...]:
        """The tables at the ends of the relationships that fit."""
        ends = {x for e in self.graph.edges if not rel.types or e.type in rel.types for x in (e.source, e.target)}
        return tuple(m for m in self.graph.nodes if m.tag in ends)

    def path_fields(self, part: A.Part, scope: dict[str, Binding]) -> dict[str, T.DataType]:
        """Node properties that a path's value carries: those read anywhere in the query, one type each."""
        tables: dict[str, NodeMapping] = {}
        for i, item in enumerate(part.items):
            if isinstance(item, A.RelPat):
                some = self.involved(item) if item.variable or part.selector else ()
            else:
                known = scope.get(item.var)
                some = known.mappings if isinstance(known, Node) else self.candidates(item.labels)
                for rel in part.items[max(0, i - 1) : i + 2 : 2]:
                    if isinstance(rel, A.RelPat) and rel.types:
                        near = {m.tag for m in self.involved(rel)}
                        some = tuple(m for m in some if m.tag in near)
            tables |= {m.tag: m for m in some}
        out: dict[str, T.DataType] = {}
        for m in tables.values():
            wanted = {p: c for p, c in m.properties.items() if self.whole or p in self.keys}
            if wanted:
                schema = self.graph.rows(m).schema
                for p, c in wanted.items():
                    out[p] = joint(out.get(p), schema[c].dataType)
        return out

    def props_struct(self, props: dict[str, tuple[str, T.DataType]], fields: dict[str, T.DataType]) -> Column:
        """The wanted properties of an entity as one struct; those it lacks are null."""
        if not fields:
            return F.struct(F.lit(None).cast("string").alias("_"))
        return F.struct(*((col(props[p][0]).cast(t) if p in props else F.lit(None).cast(t)).alias(p) for p, t in fields.items()))

    def node_value(self, n: Node, fields: dict[str, T.DataType]) -> Column:
        return F.struct(col(n.key).cast("string").alias("_key"), col(n.label).alias("_label"), self.props_struct(n.props, fields).alias("properties"))

    def node(self, pat: A.NodePat, name: str, df: DataFrame | None, scope: dict[str, Binding], state: State, in_path: bool):
        if name in scope:
            b = scope[name]
            if not isinstance(b, Node):
                if isinstance(b, Value) and isinstance(b.type, T.StructType) and "_key" in b.type.fieldNames():
                    scan, node = self.node_scan(self.candidates(pat.labels))
                    df = df.join(scan, (col(node.key).cast("string") == col(b.column).getField("_key").cast("string")) & (col(node.label) == col(b.column).getField("_label")))
                    return df, scope | {name: node}
                raise SemanticFault(f"{name!r} is not a node")
            if pat.labels is not None:
                df = df.where(self.has_labels(b, pat.labels))
        else:
            scan, b = self.node_scan(self.candidates(pat.labels))
            df = scan if df is None else df.crossJoin(scan) if df.columns else scan
            scope = scope | {name: b}
        return self.props_filter(b, pat.props, df, scope, state), scope

    def props_filter(self, b: Node | Rel, props: tuple, df: DataFrame, scope: dict[str, Binding], state: State) -> DataFrame:
        for key, e in props:
            env = Env(df, scope)
            left = Arg(col(b.props[key][0]), b.props[key][1]) if key in b.props else Arg(V.null(), T.NullType())
            df = df.where(V.equal(left, self.arg(e, env)))
        return df

    def has_labels(self, b: Node, tree: Any) -> Column:
        op, x = tree
        if op in ("is", "tag"):
            ok = sorted({m.tag for m in b.mappings if x in m.labels or (op == "tag" and x == m.tag)})
            if set(ok) == {m.tag for m in b.mappings}:
                return col(b.key).isNotNull()
            return col(b.label).isin(*ok) if ok else F.lit(False)
        if op == "not":
            return ~self.has_labels(b, x)
        out = None
        for t in x:
            c = self.has_labels(b, t)
            out = c if out is None else (out & c if op == "and" else out | c)
        return out

    def hop(self, rel: A.RelPat, target: A.NodePat, names: list[str], flipped: bool, df: DataFrame, scope: dict[str, Binding], rels: list, state: State, in_path: bool, said: A.Expr | None = None):
        """Extend from the bound node names[0] over the relationship to names[2].

        `said` is a WHERE that bounds the far node and not the near one: the far node is then met first.
        """
        direction = rel.direction
        if flipped and direction != "both":
            direction = "in" if direction == "out" else "out"
        here = scope[names[0]]
        if not isinstance(here, Node):
            raise SemanticFault(f"{names[0]!r} is not a node")
        known = scope.get(names[2])
        goal = known.mappings if isinstance(known, Node) else self.candidates(target.labels)
        if rel.variable:
            return self.var_hop(rel, target, names, direction, flipped, df, scope, rels, state, in_path, goal)
        if rel.var and rel.var in scope:
            return self.rebind(rel, target, names, direction, df, scope, rels, state, in_path, goal)
        short = None if direction == "both" or known is not None else self.held_hop(rel, target, names, direction, df, scope, rels, state, in_path, goal, here)
        if short is not None:
            return short
        edges = self.directed(rel, direction, here.mappings, goal)
        if edges is None:
            df = df.where(F.lit(False))
            if known is None:
                scan, node = self.node_scan(goal)
                df, scope = df.crossJoin(scan), scope | {names[2]: node}
            empty = self.empty_rel(df)
            return empty[0], scope | {names[1]: empty[1]}
        edf, r, near, far = edges
        on = self.same_node(here, near[0], near[1])
        if isinstance(known, Node):
            on = on & self.same_node(known, far[0], far[1])
        met = None
        if said is not None and known is None:
            scan, met = self.node_scan(goal)
            edf = edf.join(self.only(names[2], said, scan, {names[2]: met}, state), self.same_node(met, *far))
        df = df.join(edf, on)
        scope = scope | {names[1]: r}
        df = self.distinct_rels(df, r, rel, rels)
        df = self.props_filter(r, rel.props, df, scope, state)
        if met is not None:
            scope = scope | {names[2]: met}
            df = self.props_filter(met, target.props, df, scope, state)
        elif known is None:
            df, scope = self.arrive(names[2], target, far, goal, df, scope, state, in_path, rel)
        else:
            df = self.props_filter(known, target.props, df, scope, state)
            if target.labels is not None:
                df = df.where(self.has_labels(known, target.labels))
        return df, scope

    def empty_rel(self, df: DataFrame) -> tuple[DataFrame, Rel]:
        stem = fresh("r")
        r = Rel(f"{stem}_t", f"{stem}_i", f"{stem}_a", f"{stem}_b", ())
        return df.select("*", *(F.lit(None).cast("string").alias(c) for c in r.columns())), r

    def same_node(self, n: Node, key: str, label: str) -> Column:
        on = col(n.key) == col(key)
        return on if n.single else on & (col(n.label) == col(label))

    def arrive(self, name: str, pat: A.NodePat, far: tuple[str, str], goal: tuple[NodeMapping, ...], df: DataFrame, scope: dict[str, Binding], state: State, in_path: bool, rel: A.RelPat):
        """Bind the far node; its table is joined only if it is read or may lack the row."""
        sure = all(getattr(e, "enforced", False) for e in self.graph.edges if not rel.types or e.type in rel.types)
        real = None if name.startswith(" anon") else name
        if sure and not self.wanted(real, in_path) and not pat.props:
            node = Node(far[0], far[1], goal)
            return df, scope | {name: node}
        scan, node = self.node_scan(goal)
        df = df.join(scan, self.same_node(node, *far))
        scope = scope | {name: node}
        return self.props_filter(node, pat.props, df, scope, state), scope

    def directed(self, rel: A.RelPat, direction: str, here: tuple[NodeMapping, ...], goal: tuple[NodeMapping, ...]):
        """Edges as (df, rel, near columns, far columns); both directions are a union."""
        a, b = {m.tag for m in here}, {m.tag for m in goal}
        ta, tb = self._text_keys(here) if here else False, self._text_keys(goal) if goal else False
        if direction == "out":
            got = self.edge_scan(rel, a, b, (ta, tb))
            return got and (got[0], got[1], (got[1].source, got[1].ends[0]), (got[1].target, got[1].ends[1]))
        if direction == "in":
            got = self.edge_scan(rel, b, a, (tb, ta))
            return got and (got[0], got[1], (got[1].target, got[1].ends[1]), (got[1].source, got[1].ends[0]))
        stem = fresh("u")
        near, far = (f"{stem}_n", f"{stem}_nl"), (f"{stem}_f", f"{stem}_fl")
        frames, r = [], None
        for x, y, tx, ty, forth in ((a, b, ta, tb, True), (b, a, tb, ta, False)):
            got = self.edge_scan(rel, x, y, (tx, ty))
            if got is None:
                continue
            df, q = got
            ends = ((q.source, q.ends[0]), (q.target, q.ends[1]))
            n, f = ends if forth else ends[::-1]
            if not forth:
                # a loop is met once; the union's first half has it already
                df = df.where(~((col(q.source) == col(q.target)) & (col(q.ends[0]) == col(q.ends[1]))))
            if r is None:
                r = q
            r.homes |= q.homes
            renamed = [col(c).alias(d) for c, d in zip(q.columns(), self._aligned(q, r), strict=True)]
            frames.append(df.select(*renamed, col(n[0]).alias(near[0]), col(n[1]).alias(near[1]), col(f[0]).alias(far[0]), col(f[1]).alias(far[1])))
        if not frames:
            return None
        df = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1], allowMissingColumns=True)
        return df, r, near, far

    def _aligned(self, q: Rel, r: Rel) -> list[str]:
        base = [r.type, r.id, r.source, r.target, *r.ends]
        for p in q.props:
            if p not in r.props:
                r.props[p] = (f"{r.type}_p_{p}", q.props[p][1])
        return [*base, *(r.props[p][0] for p in q.props)]

    def held_hop(self, rel, target, names, direction, df, scope, rels, state, in_path, goal, here):
        """One-join hops over a foreign key that lies in one endpoint's own row."""
        mine = [(i, e) for i, e in enumerate(self.graph.edges) if not rel.types or e.type in rel.types]
        fits = [(i, e) for i, e in mine if (e.source if direction == "out" else e.target) in {m.tag for m in here.mappings} and (e.target if direction == "out" else e.source) in {m.tag for m in goal}]
        if len(fits) != 1 or not isinstance(fits[0][1], EdgeMapping):
            return None
        i, e = fits[0]
        home = self._home(e)
        far_label = e.target if direction == "out" else e.source
        far = tuple(m for m in goal if m.tag == far_label)
        if home is None or len(far) != 1 or not here.single:
            return None
        stem = fresh("r")
        r = Rel(f"{stem}_t", f"{stem}_i", f"{stem}_a", f"{stem}_b", (e.type,), {}, homes={self.home_of(e)})
        if i in here.held:  # the key is in the row already
            if not self.wanted(None if names[2].startswith(" anon") else names[2], in_path) and not target.props and e.enforced:
                df = df.where(col(here.held[i]).isNotNull())
                node = Node(f"{stem}_k", f"{stem}_l", far)
                df = df.select("*", col(here.held[i]).alias(node.key), F.lit(far_label).alias(node.label))
            else:
                scan, node = self.node_scan(far)
                df = df.join(scan, col(here.held[i]) == col(node.key))
            ident = here.key
        elif far_label == home:
            scan, node = self.node_scan(far)
            df = df.join(scan, col(node.held[i]) == col(here.key))
            ident = node.key
        else:
            return None
        a, b = (here, node) if direction == "out" else (node, here)
        edf, _, _, _, props = self.graph.edge_rows(e, self)
        source = here if i in here.held else node
        extra = {}
        back = {c: p for p, c in source.mappings[0].properties.items()}
        for p in e.properties:
            if e.properties[p] in back:
                extra[p] = source.props[back[e.properties[p]]]
            else:
                return None
        df = df.select("*", F.lit(e.type).alias(r.type), self.identity(e, col(ident), False).alias(r.id), col(a.key).alias(r.source), col(b.key).alias(r.target))
        r.props = extra
        self.fan = "one" if i in here.held else "many"
        scope = scope | {names[1]: r, names[2]: node}
        df = self.distinct_rels(df, r, rel, rels)
        df = self.props_filter(r, rel.props, df, scope, state)
        df = self.props_filter(node, target.props, df, scope, state)
        return df, scope

    def rebind(self, rel, target, names, direction, df, scope, rels, state, in_path, goal):
        """A relationship variable that is bound already: its ends link the nodes."""
        r, here, known = scope[names[1]], scope[names[0]], scope.get(names[2])
        if not isinstance(r, Rel):
            raise SemanticFault(f"{names[1]!r} is not a relationship")
        ways = {"out": [(r.source, r.target)], "in": [(r.target, r.source)], "both": [(r.source, r.target), (r.target, r.source)]}[direction]
        if len(ways) == 2:
            df = df.where((col(here.key) == col(r.source)) | (col(here.key) == col(r.target)))
            stem = fresh("f")
            df = df.select("*", F.when(col(here.key) == col(r.source), col(r.target)).otherwise(col(r.source)).alias(stem))
            far = stem
        else:
            df, far = df.where(col(here.key) == col(ways[0][0])), ways[0][1]
        if isinstance(known, Node):
            return df.where(col(known.key) == col(far)), scope
        scan, node = self.node_scan(goal)
        df = df.join(scan, col(node.key) == col(far))
        scope = scope | {names[2]: node}
        return self.props_filter(node, target.props, df, scope, state), scope

    def distinct_rels(self, df: DataFrame, r: Rel, pat: A.RelPat, rels: list) -> DataFrame:
        for other, opat in rels:
            if pat.types and opat.types and not set(pat.types) & set(opat.types):
                continue
            if isinstance(other, Rel) and r.homes is not None and other.homes is not None and not r.homes & other.homes:
                continue  # from different tables or between other labels
            if isinstance(other, RelList):
                df = df.where(~F.exists(col(other.column), lambda x: (x["_type"] == col(r.type)) & (x["_id"] == col(r.id).cast("string"))))
            else:
                df = df.where(~((col(r.type) == col(other.type)) & (col(r.id).cast("string") == col(other.id).cast("string")))) if str(df.schema[r.id].dataType) != str(df.schema[other.id].dataType) else df.where(~((col(r.type) == col(other.type)) & (col(r.id) == col(other.id))))
        rels.append((r, pat))
        return df

    # --- variable length -------------------------------------------------------------------

    def step_struct(self, r: Rel, with_props: bool) -> Column:
        props = {p: t for p, (_, t) in r.props.items()} if with_props else {}
        return F.struct(
            col(r.type).alias("_type"), col(r.id).cast("string").alias("_id"), col(r.source).cast("string").alias("_source"),
            col(r.target).cast("string").alias("_target"), self.props_struct(r.props, props).alias("properties"),
        )

    def steps(self, rel: A.RelPat, direction: str, show: bool, in_path: bool, stem: str):
        """One row for each way along a fitting relationship: step, near key and label, far key and label, far node.

        None where no relationship fits; the columns are named after `stem`.
        """
        tables = self.involved(rel)
        edges = self.directed(rel, direction, tables, tables)
        if edges is None:
            return None
        edf, r, near, far = edges
        names = [f"{stem}_{x}" for x in ("s", "a", "al", "b", "bl", "bn")]
        far_node = F.struct(col(far[0]).cast("string").alias("_key"), col(far[1]).alias("_label"), self.props_struct({}, {}).alias("properties"))
        if in_path and self.fields:
            scan, node = self.node_scan(tables)
            edf = edf.join(scan, self.same_node(node, *far))
            far_node = self.node_value(node, self.fields)
        columns = [self.step_struct(r, show), col(near[0]), col(near[1]), col(far[0]), col(far[1]), far_node]
        hops = edf.select(*(c.alias(n) for c, n in zip(columns, names, strict=True)), *(col(c) for c, _ in r.props.values()))
        for key, e in rel.props:
            hops = self.props_filter(r, ((key, e),), hops, {}, State(None)) if key in r.props else hops.where(F.lit(False))
        if rel.step_where is not None:
            inner: dict[str, Binding] = {rel.step_vars[0]: Rel(*(f"{stem}_w{i}" for i in range(4)), r.types, r.props)}
            parts = [col(names[0]).getField(f).alias(f"{stem}_w{i}") for i, f in enumerate(("_type", "_id", "_source", "_target"))]
            if rel.step_vars[1]:
                inner[rel.step_vars[1]] = Value(names[5], hops.schema[names[5]].dataType)
            hops = hops.select("*", *parts)
            hops = hops.where(self.arg(rel.step_where, Env(hops, inner)).col)
        return hops.select(*names), names, r

    def var_hop(self, rel, target, names, direction, flipped, df, scope, rels, state, in_path, goal):
        """Walks of a range of lengths, each step a join with the edges. By mode: no relationship twice
        (TRAIL, the default), no node twice (ACYCLIC), none but the first as the last (SIMPLE), or
        any walk (WALK, which needs an upper bound)."""
        low, high, mode = rel.low if rel.low is not None else 1, rel.high, rel.mode or "TRAIL"
        if mode == "WALK" and high is None:
            raise ArgumentFault("a WALK needs an upper bound")
        here, known = scope[names[0]], scope.get(names[2])
        tables = self.involved(rel)
        stem = fresh("v")
        cur, label, trail, between = f"{stem}_c", f"{stem}_cl", f"{stem}_r", f"{stem}_n"
        real = None if names[1].startswith(" anon") else names[1]
        show = self.wanted(real, in_path)
        if not isinstance(known, Node):
            near = {m.tag for m in tables} | ({m.tag for m in here.mappings} if low == 0 else set())
            goal = tuple(m for m in goal if m.tag in near)
        any_text = self._text_keys(tuple(dict.fromkeys((*tables, *here.mappings, *goal))))
        start_key = col(here.key).cast("string") if any_text else col(here.key)
        got = self.steps(rel, direction, show, in_path, stem)
        one = "struct<_type:string,_id:string,_source:string,_target:string,properties:struct<_:string>>"
        fields = self.fields if in_path else {}
        at_node = F.struct(start_key.cast("string").alias("_key"), col(here.label).alias("_label"), self.props_struct(here.props, fields).alias("properties"))
        node_kind = df.select(at_node.alias("x")).schema["x"].dataType.simpleString()
        kind_ = got[0].schema[got[1][0]].dataType.simpleString() if got is not None else one
        met = f"{stem}_m"  # nodes met so far, the first included: for modes that never meet one twice
        at = df.select("*", start_key.alias(cur), col(here.label).alias(label), F.array().cast(f"array<{kind_}>").alias(trail), F.array().cast(f"array<{node_kind}>").alias(between))
        once = mode in ("ACYCLIC", "SIMPLE")
        if once:
            at = at.withColumn(met, F.array(F.struct(col(cur).alias("k"), col(label).alias("l"))))
        out = [at] if low == 0 else []
        if got is not None:
            hops, (step, k, kl, f_, fl, fn), _ = got
            depth, frontier = 0, at
            while high is None or depth < high:
                grown = frontier.join(hops, (col(cur) == (col(k).cast("string") if any_text else col(k))) & (col(label) == col(kl)))
                same = lambda x: (x["_type"] == col(step)["_type"]) & (x["_id"] == col(step)["_id"])
                if mode != "WALK":
                    grown = grown.where(~F.exists(col(trail), same))
                for other, _ in rels if mode != "WALK" else ():
                    if isinstance(other, Rel):
                        grown = grown.where(~((col(step)["_type"] == col(other.type)) & (col(step)["_id"] == col(other.id).cast("string"))))
                    else:
                        grown = grown.where(~F.exists(col(other.column), same))
                hidden = {cur, label, trail, between, met}
                keep = [col(c) for c in frontier.columns if c not in hidden]
                far_key = col(f_).cast("string") if any_text else col(f_)
                more = []
                if once:
                    far = F.struct(far_key.alias("k"), col(fl).alias("l"))
                    before = col(met) if mode == "ACYCLIC" else F.slice(col(met), 2, F.greatest(F.size(met), F.lit(1)))
                    grown = grown.where(~F.array_contains(before, far))
                    if mode == "SIMPLE":  # a walk that is back at its start ends there
                        grown = grown.where((F.size(met) == 1) | (F.element_at(met, -1) != F.element_at(met, 1)))
                    more = [F.array_append(col(met), far).alias(met)]
                been = F.array_append(col(between), col(fn)) if in_path else col(between)
                frontier = grown.select(*keep, far_key.alias(cur), col(fl).alias(label), F.array_append(col(trail), col(step)).alias(trail), been.alias(between), *more)
                depth += 1
                if high is None or high > UNROLL:
                    frontier = self.graph.settle(frontier)
                    if frontier.isEmpty():
                        break
                if depth >= low:
                    out.append(frontier)
        df = out[0] if out else at.where(F.lit(False))
        for o in out[1:]:
            df = df.unionByName(o)
        rl = RelList(trail, between, {p: t for p, (_, t) in got[2].props.items()} if got is not None and show else {}, fields)
        if flipped:
            # read from the other end: the walk's first node is the last one, so nodes between shift by one
            df = df.withColumn(trail, F.reverse(col(trail)))
            inner = F.slice(col(between), F.lit(1), F.greatest(F.lit(0), F.size(col(between)) - 1))
            df = df.withColumn(between, F.when(F.size(col(between)) == 0, col(between)).otherwise(F.concat(F.reverse(inner), F.slice(col(between), -1, 1))))
        scope = scope | {names[1]: rl}
        rels.append((rl, rel))
        if isinstance(known, Node):
            key = col(known.key).cast("string") if any_text else col(known.key)
            df = df.where((key == col(cur)) & (col(known.label) == col(label)))
            return self.props_filter(known, target.props, df, scope, state), scope
        sure = not any_text and all(getattr(e, "enforced", False) for e in self.graph.edges if not rel.types or e.type in rel.types)
        if sure and low > 0 and not self.wanted(None if names[2].startswith(" anon") else names[2], in_path) and not target.props:
            df = df.where(col(label).isin(*(m.tag for m in goal))) if len(goal) < len(tables) else df
            return df, scope | {names[2]: Node(cur, label, goal)}
        scan, node = self.node_scan(goal)
        key = col(node.key).cast("string") if any_text else col(node.key)
        df = df.join(scan, (key == col(cur)) & (col(node.label) == col(label)))
        scope = scope | {names[2]: node}
        return self.props_filter(node, target.props, df, scope, state), scope

    def shortest(self, part: A.Part, df, scope, state, where):
        """Shortest paths between the ends: a breadth-first search from the distinct first nodes that
        ends when every wanted last node is reached. Ends that are one node have a path only if the
        lower bound is 0."""
        from ..operators import paths

        first, rel, last = part.items
        names = [i.var or fresh(" anon") for i in part.items]
        for pat, name in ((first, names[0]), (last, names[2])):
            if name in scope and not isinstance(scope[name], Node):
                raise SemanticFault(f"{name!r} is not a node")
        low = 1 if rel.low is None else rel.low
        high = rel.high if rel.variable else 1
        direction = rel.direction
        if names[0] not in scope and names[2] in scope:  # search from the end that is known
            direction = {"out": "in", "in": "out"}.get(direction, direction)
            first, last, names = last, first, names[::-1]
            turned = True
        else:
            turned = False
        df, scope = self.node(first, names[0], df, scope, state, True)
        df = self.only(names[0], where, df, scope, state)
        a, stem = scope[names[0]], fresh("p")
        got = self.steps(rel, direction, True, part.path is not None, stem)
        if got is None and low > 0:
            raise SemanticFault("no relationship fits the shortest path")
        tag = lambda n: F.struct(col(n.label).alias("l"), col(n.key).cast("string").alias("k"))
        b = scope.get(names[2])
        if b is not None:
            df = self.props_filter(b, last.props, df, scope, state)
            df = df.where(self.has_labels(b, last.labels)) if last.labels is not None else df
            wanted, ends = df.select(tag(a).alias("_s"), tag(b).alias("_e")).distinct(), None
        else:
            goal = tuple(m for m in self.candidates(last.labels) if m in self.involved(rel) or low == 0)
            ends, b = self.node_scan(goal)
            ends = self.props_filter(b, last.props, ends, scope | {names[2]: b}, state)
            ends = self.only(names[2], where, ends, {names[2]: b}, state)
            wanted = ends.select(tag(b).alias("_e")).distinct()
        seeds = df.select(tag(a).alias("_s")).distinct()
        hops = None
        if got is not None:
            h, (step, k, kl, f_, fl, fn), r = got
            pair = lambda x, y: F.struct(col(y).alias("l"), col(x).cast("string").alias("k"))
            hops = h.select(pair(k, kl).alias("_a"), pair(f_, fl).alias("_b"), col(step).alias("_step"), col(fn).alias("_node"))
        found = paths.shortest(seeds, wanted, hops, low, high, part.selector == "all_shortest", self.graph.settle)
        steps, nodes = (F.reverse("_path"), F.reverse("_nodes")) if turned else (col("_path"), col("_nodes"))
        if turned:  # without the node searched from, which is the pattern's last
            size = F.size("_nodes")
            nodes = F.when(size == 0, col("_nodes")).otherwise(F.concat(F.reverse(F.slice("_nodes", F.lit(1), F.greatest(size - 1, F.lit(0)))), F.slice("_nodes", -1, 1)))
        found = found.select(col("_s").alias(f"{stem}_s"), col("_e").alias(f"{stem}_e"), steps.alias(f"{stem}_r"), nodes.alias(f"{stem}_n"))
        if ends is not None:
            found = found.join(ends, tag(b) == col(f"{stem}_e"))
            df = df.join(found, tag(a) == col(f"{stem}_s"))
            scope = scope | {names[2]: b}
        else:
            df = df.join(found, (tag(a) == col(f"{stem}_s")) & (tag(b) == col(f"{stem}_e")))
        props = {p: t for p, (_, t) in r.props.items()} if got is not None else {}
        rl = RelList(f"{stem}_r", f"{stem}_n", props, self.fields)
        scope = scope | {names[1]: rl}
        if part.path:
            scope = scope | {part.path: Path(tuple(names[::-1] if turned else names), self.fields)}
        return df, scope

    def only(self, name: str, where: A.Expr | None, df: DataFrame, scope: dict[str, Binding], state: State) -> DataFrame:
        """`df` with those conditions that read nothing but `name`: they bound a search before it begins."""
        for c in conjuncts(where):
            if variables(c) == {name} and not any(isinstance(x, (A.Sub, A.PatternComp)) for x in self._all(c)):
                df = df.where(self.arg(c, Env(df, {name: scope[name]})).col.cast("boolean"))
        return df

    # === OPTIONAL MATCH and subqueries =====================================================

    def linked(self, parts: tuple[A.Part, ...], where: A.Expr | None, state: State) -> tuple[State, Column] | None:
        """The pattern on its own, and the condition that ties it to the outer row.

        Nodes that the outer row binds are scanned afresh and equated by key, so outer rows keep
        their multiplicity. What the pattern's WHERE says about other outer names goes into the
        condition; None where the pattern needs more than that.
        """
        return self._linked_many(parts, where, state)

    def _linked_many(self, parts, where, state) -> tuple[State, Column] | None:
        """Several outer nodes: the first is scanned, the others are met by the pattern itself."""
        outer = [n for n in dict.fromkeys(i.var for p in parts for i in p.items if i.var) if n in state.scope]
        if any(not isinstance(state.scope[n], Node) for n in outer):
            return None
        swap = {n: fresh(f"{n} again") for n in outer}

        def node(i):
            if isinstance(i, A.NodePat) and i.var in swap:
                tree = i.labels
                b = state.scope[i.var]
                if tree is None and b.mappings:
                    tree = ("or", tuple(("tag", m.tag) for m in b.mappings))
                return A.NodePat(swap[i.var], tree, i.props)
            return i

        for n, s in swap.items():
            self.used[s] = set(self.used.get(n, set()))
        new = tuple(A.Part(p.path, tuple(node(i) for i in p.items), p.selector) for p in parts)
        inner = self.pattern(new, State(None))
        return self._tie(inner, where, state, {n: s for n, s in swap.items()})

    def _tie(self, inner: State, where: A.Expr | None, state: State, link: dict[str, str]) -> tuple[State, Column] | None:
        on = F.lit(True)
        for n, s in link.items():
            a, b = state.scope[n], inner.scope[s]
            on = on & (col(a.key) == col(b.key))
            if not (a.single and b.single):
                on = on & (col(a.label) == col(b.label))
        visible = {n: b for n, b in inner.scope.items()} | {n: inner.scope[s] for n, s in link.items()}
        for c in conjuncts(where):
            free = variables(c) & (set(state.scope) | set(visible))
            if free <= set(visible):
                keep = State(inner.df, visible)
                keep = self.condition(c, keep)
                inner = State(keep.df, inner.scope)
            else:
                if any(isinstance(x, (A.Sub, A.PatternComp)) for x in self._all(c)):
                    return None
                both = {**state.scope, **visible}
                on = on & self.arg(c, Env(None, both)).col
        return State(inner.df, visible), on

    def _all(self, e: Any) -> list[Any]:
        return [e, *(y for c in children(e) for y in self._all(c))]

    def optional(self, m: A.Match, state: State) -> State:
        if state.df is None or not state.df.columns:
            state = State(self.spark.range(1).select(F.lit(1).alias(fresh("one"))), state.scope, state.order, state.corr, state.outer)
        props = [e for part in m.parts for i in part.items for _, e in i.props]
        reads = set().union(*(variables(e) for e in props), set()) & set(state.scope)
        linked = None if reads else self.linked(m.parts, m.where, state)
        if linked is None:
            return self.optional_per_import(m, state)
        inner, on = linked
        df = state.df.join(inner.df, on, "left")
        fresh_names = {n: b for n, b in inner.scope.items() if n not in state.scope}
        return State(df, state.scope | fresh_names, state.order, state.corr, state.outer)

    def optional_per_import(self, m: A.Match, state: State) -> State:
        """An optional pattern that reads further outer values: matched once per distinct import, joined back."""
        names = sorted(n for n in self._outer_names((m.parts, m.where)) if n in state.scope)
        inner, link = self.imported(state, names)
        got = self.filtered(self.pattern(m.parts, inner, m.where), m.where)
        new = {n: b for n, b in got.scope.items() if n not in state.scope}
        keep = list(dict.fromkeys(c for b in new.values() for c in b.columns()))
        if not link:
            df = state.df.join(got.df.select(*(col(c) for c in keep)), F.lit(True), "left")
        else:
            df = self.joined_back(state.df, got.df, link, "left", keep)
        return State(df, state.scope | new, state.order, state.corr, state.outer)

    def prepared(self, state: State, exprs: list[A.Expr]) -> tuple[State, Env]:
        """Join what subqueries in the expressions yield and make an environment that knows them."""
        df, swap = state.df, {}
        for e in exprs:
            for sub in self._all(e):
                key = repr(sub)
                if key in swap:
                    continue
                if isinstance(sub, A.Func) and sub.name in STARTS | ENDS and isinstance(sub.args[0], A.Var) and isinstance(state.scope.get(sub.args[0].name), Rel):
                    df, node = self.end_of(state.scope[sub.args[0].name], sub.name in STARTS, df)
                    c = self.value_of(node)
                    swap[key] = (c, df.select(c.alias("x")).schema["x"].dataType)
                    continue
                if not isinstance(sub, (A.Sub, A.PatternComp)):
                    continue
                df, c, t = self.subquery(sub, State(df, state.scope, state.order, state.corr, state.outer))
                swap[key] = (c, t)
        return State(df, state.scope, state.order, state.corr, state.outer), Env(df, state.scope, {}, swap)

    def end_of(self, r: Rel, start: bool, df: DataFrame) -> tuple[DataFrame, Node]:
        """Join the node at one end of a relationship."""
        fits = [e for e in self.graph.edges if not r.types or e.type in r.types]
        tags = {e.source if start else e.target for e in fits}
        scan, node = self.node_scan(tuple(m for m in self.graph.nodes if m.tag in tags))
        key = r.source if start else r.target
        on = col(node.key).cast("string") == col(key).cast("string") if df.schema[key].dataType != scan.schema[node.key].dataType else col(node.key) == col(key)
        if r.ends is not None and not node.single:
            on = on & (col(node.label) == col(r.ends[0 if start else 1]))
        return df.join(scan, on, "left"), node

    def subquery(self, sub: A.Sub | A.PatternComp, state: State) -> tuple[DataFrame, Column, T.DataType]:
        if state.df is None or not state.df.columns:
            state = State(self.spark.range(1).select(F.lit(1).alias(fresh("one"))), state.scope)
        if isinstance(sub, A.Sub) and sub.query is not None:
            return self.sub_full(sub.kind, sub.query, state)
        parts = sub.parts if isinstance(sub, A.Sub) else (sub.part,)
        outer = dict.fromkeys(i.var for p in parts for i in p.items if i.var and isinstance(state.scope.get(i.var), Node))
        body = [*conjuncts(sub.where), *([sub.out] if getattr(sub, "out", None) is not None else []), *(e for part in parts for i in part.items for _, e in i.props)]
        reads = set().union(*(variables(c) for c in body), set()) & set(state.scope)
        bound = {i.var for part in parts for i in part.items if i.var and i.var in state.scope}
        if reads - set(outer) or bound - set(outer):  # outer values beside the pattern's nodes: once per distinct import
            item = A.Item(sub.out if getattr(sub, "out", None) is not None else A.Lit(1), "one")
            match = A.Match(parts, sub.where, False)
            whole = A.Query((A.Single((match, A.Return(A.Projection((item,), False, False, (), None, None)))),), ())
            kind_ = "collect" if isinstance(sub, A.PatternComp) else sub.kind
            return self.sub_full(kind_, whole, state)
        linked = self._linked_many(parts, sub.where, state)
        if linked is None:
            raise UnsupportedFault("a subquery whose pattern starts from a value")
        inner, on = linked
        keys = []
        for n in outer:
            keys += [inner.scope[n].key, inner.scope[n].label]
        name = fresh("q")
        out_env: Any = None
        if isinstance(sub, A.PatternComp) or sub.kind == "collect":
            inner, env = self.prepared(inner, [sub.out])
            out_env = self.arg(sub.out, env)
            agg = F.collect_list(F.struct(out_env.col.alias("v"))).alias(name)
        else:
            agg = F.count(F.lit(1)).alias(name)
        grouped = inner.df.groupBy(*keys).agg(agg) if keys else inner.df.agg(agg)
        on = F.lit(True)
        for n in outer:
            a, b = state.scope[n], inner.scope[n]
            on = on & (col(a.key) == col(b.key)) & (F.lit(True) if a.single and b.single else col(a.label) == col(b.label))
        df = state.df.join(grouped.select(*keys, name), on, "left") if keys else state.df.crossJoin(grouped)
        df = df.select(*state.df.columns, name)
        if out_env is not None:
            t = T.ArrayType(out_env.type)
            return df, F.coalesce(F.transform(col(name), lambda s: s["v"]), F.array().cast(t)), t
        n = F.coalesce(col(name), F.lit(0).cast("long"))
        return (df, n > 0, T.BooleanType()) if sub.kind == "exists" else (df, n, T.LongType())

    def sub_full(self, what: str, q: A.Query, state: State) -> tuple[DataFrame, Column, T.DataType]:
        """EXISTS, COUNT or COLLECT over a whole query: run once per distinct import, then joined."""
        free = sorted(n for n in self._outer_names(q) if n in state.scope)
        inner_state, link = self.imported(state, free)
        got = self.query(self._with_return(q), inner_state)
        name = fresh("q")
        grouped = got.df.groupBy(*inner_state.corr)
        if what == "collect":
            only = next(iter(got.scope))
            c = self.value_of(got.scope[only])
            kind_ = got.df.select(c.alias("x")).schema["x"].dataType
            grouped = grouped.agg(F.collect_list(F.struct(c.alias("v"))).alias(name))
        else:
            grouped = grouped.agg(F.count(F.lit(1)).alias(name))
        df = self.joined_back(state.df, grouped, link, "left", [name])
        if what == "collect":
            t = T.ArrayType(kind_)
            return df, F.coalesce(F.transform(col(name), lambda v: v["v"]), F.array().cast(t)), t
        n = F.coalesce(col(name), F.lit(0).cast("long"))
        return (df, n > 0, T.BooleanType()) if what == "exists" else (df, n, T.LongType())

    def _with_return(self, q: A.Query) -> A.Query:
        parts = []
        for p in q.parts:
            if not isinstance(p.clauses[-1], A.Return):
                one = A.Return(A.Projection((A.Item(A.Lit(1), "one"),), False, False, (), None, None))
                p = A.Single((*p.clauses, one))
            parts.append(p)
        return A.Query(tuple(parts), q.all)

    def _outer_names(self, q: Any) -> set[str]:
        names: set[str] = set()

        def visit(e: Any) -> None:
            if isinstance(e, A.Var):
                names.add(e.name)
            if isinstance(e, (A.NodePat, A.RelPat)) and e.var:
                names.add(e.var)
            if isinstance(e, (tuple, list)):
                for x in e:
                    visit(x)
            elif hasattr(e, "__dataclass_fields__"):
                for f in e.__dataclass_fields__:
                    visit(getattr(e, f))

        visit(q)
        return names

    def imported(self, state: State, names: list[str]) -> tuple[State, list[tuple[str, str]]]:
        """Distinct imported values as a state of their own; hidden copies are the way back."""
        names = list(dict.fromkeys(x for n in names for x in ((n, *state.scope[n].items) if isinstance(state.scope[n], Path) else (n,))))
        if not names:
            return State(None), []
        cols = list(dict.fromkeys(c for n in names for c in state.scope[n].columns()))
        ident = [c for n in names for c in ([state.scope[n].key, state.scope[n].label] if isinstance(state.scope[n], Node) else [state.scope[n].type, state.scope[n].id] if isinstance(state.scope[n], Rel) else state.scope[n].columns())]
        ident = list(dict.fromkeys(ident))
        link = [(c, fresh("corr")) for c in ident]
        rename = {c: fresh("im") for c in cols}
        outer = state.df.select(*(col(c) for c in cols)).dropDuplicates(ident)
        df = outer.select(*(col(c).alias(rename[c]) for c in cols), *(col(c).alias(h) for c, h in link))
        scope = {n: self.renamed(state.scope[n], rename) for n in names}
        corr = [h for _, h in link]
        return State(df, scope, [], corr, df.select(*corr)), link

    def renamed(self, b: Binding, names: dict[str, str]) -> Binding:
        r = lambda c: names.get(c, c)
        props = lambda p: {k: (r(c), t) for k, (c, t) in p.items()}
        if isinstance(b, Value):
            return Value(r(b.column), b.type)
        if isinstance(b, Node):
            return Node(r(b.key), r(b.label), b.mappings, props(b.props), {i: r(c) for i, c in b.held.items()})
        if isinstance(b, Rel):
            return Rel(r(b.type), r(b.id), r(b.source), r(b.target), b.types, props(b.props), b.ends and tuple(map(r, b.ends)))
        if isinstance(b, RelList):
            return RelList(r(b.column), r(b.between))
        return b

    def joined_back(self, df: DataFrame, inner: DataFrame, link: list[tuple[str, str]], how: str, keep: list[str]) -> DataFrame:
        if not link:
            return df.crossJoin(inner.select(*(col(k) for k in keep)))
        on = F.lit(True)
        for c, h in link:
            on = on & col(c).eqNullSafe(col(h))
        return df.join(inner, on, how).select(*(col(c) for c in df.columns), *(col(k) for k in keep))

    def call_sub(self, c: A.CallSub, state: State) -> State:
        q, names = c.query, []
        parts = []
        for p in q.parts:
            first = p.clauses[0]
            if isinstance(first, A.With) and not first.body.where and all(isinstance(i.expr, A.Var) and i.expr.name == i.name for i in first.body.items) and (first.body.items or first.body.star):
                names += list(state.scope) if first.body.star else [i.name for i in first.body.items]
                p = A.Single(p.clauses[1:])
            parts.append(p)
        q = A.Query(tuple(parts), q.all)
        names = list(dict.fromkeys(names))
        for n in names:
            if n not in state.scope:
                raise SemanticFault(f"{n!r} is not defined")
        inner_state, link = self.imported(state, names) if names else (State(None), [])
        got = self.query(q, inner_state)
        if not isinstance(q.parts[0].clauses[-1], A.Return):
            return state
        clash = set(got.scope) & set(state.scope)
        if clash:
            raise SemanticFault(f"{sorted(clash)} are already bound")
        keep = list(dict.fromkeys(c for b in got.scope.values() for c in b.columns()))
        df = state.df if state.df is not None and state.df.columns else self.spark.range(1).select(F.lit(1).alias(fresh("one")))
        return State(self.joined_back(df, got.df, link, "inner", keep), state.scope | got.scope, state.order, state.corr, state.outer)

    def call_proc(self, c: A.CallProc, state: State) -> State:
        args = [self.constant(a) for a in (c.args or ())]
        df = self.graph.procedure(c.name, args)
        names = c.yields or tuple((n, n) for n in df.columns)
        for n, _ in names:
            if n not in df.columns:
                raise SemanticFault(f"{c.name} does not yield {n!r}")
        rows = df.select(*(col(n).alias(a) for n, a in names))
        scope = {a: Value(a, rows.schema[a].dataType) for _, a in names}
        out = rows if state.df is None or not state.df.columns else state.df.crossJoin(rows)
        got = State(out, state.scope | scope, state.order, state.corr, state.outer)
        return self.filtered(got, c.where)

    # === UNWIND and projections ============================================================

    def unwind(self, c: A.Unwind, state: State) -> State:
        state, env = self.prepared(state, [c.source])
        arg = self.arg(c.source, env)
        name = fresh("u")
        df = self.base(state)
        if isinstance(arg.type, T.NullType):
            arg = Arg(F.array().cast("array<string>"), T.ArrayType(T.StringType()))
        if not isinstance(arg.type, T.ArrayType):
            arg = Arg(F.when(arg.col.isNotNull(), F.array(arg.col)), T.ArrayType(arg.type))
        pos = fresh("pos")
        df = df.select("*", F.posexplode(arg.col).alias(pos, name))
        scope = state.scope | {c.var: Value(name, arg.type.elementType)}
        return State(df, scope, [*state.order, (pos, False)], state.corr, state.outer)

    def project(self, p: A.Projection, state: State, final: bool, weight: str | None = None) -> State:
        items = list(p.items)
        if p.star:
            if not state.scope and not items:
                raise SemanticFault("* needs variables in scope")
            have = {i.name for i in items}
            items = [A.Item(A.Var(n), n) for n in sorted(state.scope) if not n.startswith(" ") and n not in have] + items
        if len({i.name for i in items}) != len(items):
            raise SemanticFault("column names must differ")
        order = [A.Order(self._alias(o.expr, items), o.descending) for o in p.order]
        has_agg = any(aggregated(i.expr) for i in items)
        state, env = self.prepared(state, [*(i.expr for i in items), *(o.expr for o in order)])
        if has_agg:
            out, order_cols = self.aggregate(items, order, state, env, weight)
        else:
            out, order_cols = self.select(items, order, state, env, p.distinct)
        if p.distinct:
            cols = [*out.corr, *dict.fromkeys(c for b in out.scope.values() for c in self._identity(b))]
            out.df = out.df.dropDuplicates(cols)
        out = self.sliced(out, order_cols, p)
        if p.where is not None:
            out = self.filtered(out, p.where)
        return self.finished(out, [i.name for i in items], order_cols) if final else out

    def _identity(self, b: Binding) -> list[str]:
        return [b.key, b.label] if isinstance(b, Node) else [b.type, b.id] if isinstance(b, Rel) else b.columns()

    def _alias(self, e: A.Expr, items: list[A.Item]) -> A.Expr:
        """ORDER BY may name a projected column by its text."""
        for i in items:
            if repr(i.expr) == repr(e):
                return A.Var(i.name)
        return e

    def select(self, items, order, state: State, env: Env, distinct: bool):
        df, scope, cols = self.base(state), {}, []
        for i in items:
            b = state.scope.get(i.expr.name) if isinstance(i.expr, A.Var) else None
            if b is not None and not isinstance(b, Value):
                scope[i.name] = b
                if isinstance(b, Path):
                    for n in b.items:
                        cols += state.scope[n].columns()
                        scope[n] = state.scope[n]
                else:
                    cols += b.columns()
                continue
            a = self.arg(i.expr, env)
            name = fresh("c")
            scope[i.name] = Value(name, a.type)
            cols.append(a.col.alias(name))
        order_cols = []
        names = {i.name: i for i in items}
        for o in order:
            name = fresh("o")
            if isinstance(o.expr, A.Var) and o.expr.name in names and not (isinstance(names[o.expr.name].expr, A.Var) and o.expr.name in state.scope):
                src = names[o.expr.name].expr
            else:
                src = self._expand_alias(o.expr, names)
            cols.append(self.sort_key(self.arg(src, env)).alias(name))
            order_cols.append((name, o.descending))
        keep = [c for c, _ in state.order if not distinct] if not order else []
        seen: set[str] = set()
        final = []
        for c in [*state.corr, *cols, *keep]:
            if isinstance(c, str):
                if c in seen:
                    continue
                seen.add(c)
                c = col(c)
            final.append(c)
        out = State(df.select(*final), scope, order_cols or (state.order if not distinct else []), state.corr, state.outer)
        return out, order_cols

    def _expand_alias(self, e: A.Expr, names: dict[str, A.Item]) -> A.Expr:
        """Replace projected names inside an ORDER BY expression by what they stand for."""
        import dataclasses

        if isinstance(e, A.Var) and e.name in names:
            return names[e.name].expr
        if not dataclasses.is_dataclass(e):
            return tuple(self._expand_alias(x, names) for x in e) if isinstance(e, tuple) else e
        if isinstance(e, (A.Sub, A.PatternComp)):
            return e
        return dataclasses.replace(e, **{f: self._expand_alias(getattr(e, f), names) for f in e.__dataclass_fields__})

    def sort_key(self, a: Arg) -> Column:
        if isinstance(a.type, T.MapType):
            return F.to_json(a.col)
        return a.col

    def sliced(self, out: State, order_cols, p: A.Projection) -> State:
        df = out.df
        keys = [V.ordered(col(n), d) for n, d in order_cols]
        skip = self.bound(p.skip, "SKIP") if p.skip is not None else 0
        limit = self.bound(p.limit, "LIMIT") if p.limit is not None else None
        if out.corr and (skip or limit is not None):
            from pyspark.sql import Window

            w = Window.partitionBy(*out.corr).orderBy(*(keys or [F.lit(0)]))
            rn = fresh("rn")
            df = df.withColumn(rn, F.row_number().over(w)).where(col(rn) > skip)
            if limit is not None:
                df = df.where(col(rn) <= skip + limit)
        elif not out.corr:
            if keys:
                df = df.orderBy(*keys)
            if skip:
                df = df.offset(skip)
            if limit is not None:
                df = df.limit(limit)
        return State(df, out.scope, out.order, out.corr, out.outer)

    def bound(self, e: A.Expr, what: str) -> int:
        n = self.constant(e)
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise ArgumentFault(f"{what} needs a non-negative integer")
        return n

    def constant(self, e: A.Expr) -> Any:
        if variables(e):
            raise SemanticFault("this expression may not read variables")
        if isinstance(e, A.Lit):
            return e.value
        if isinstance(e, A.Param):
            return self.param(e.name)
        a = self.arg(e, Env(None, {}))
        return self.spark.range(1).select(a.col.alias("x")).first()["x"]

    def param(self, name: str) -> Any:
        if name not in self.params:
            raise ArgumentFault(f"parameter ${name} is missing")
        return self.params[name]

    def finished(self, out: State, names: list[str], order_cols) -> State:
        df = out.df.select(*(col(c) for c in out.corr), *(self.value_of(out.scope[n], out.scope).alias(n) for n in names))
        return State(df, {n: Value(n, df.schema[n].dataType) for n in names}, [], out.corr, out.outer)

    # --- aggregation -----------------------------------------------------------------------

    def aggregate(self, items, order, state: State, env: Env, weight: str | None = None):
        keys = [i for i in items if not aggregated(i.expr)]
        found: dict[str, tuple[str, A.Func]] = {}

        def gather(e: Any) -> None:
            if is_aggregate(e):
                if any(aggregated(x) for x in e.args):
                    raise SemanticFault("aggregates cannot be nested")
                found.setdefault(repr(e), (fresh("a"), e))
                return
            for c in children(e):
                gather(c)

        for i in items:
            gather(i.expr)
        names = {i.name: i for i in items}
        for o in order:
            gather(self._expand_alias(o.expr, names))
        df, group, scope, firsts = self.base(state), [], {}, []
        swap: dict[str, tuple[Column, T.DataType]] = {}
        for i in keys:
            b = state.scope.get(i.expr.name) if isinstance(i.expr, A.Var) else None
            if b is not None and not isinstance(b, (Value, Path)):
                group += self._identity(b)
                scope[i.name] = b
                firsts += [c for c in b.columns() if c not in self._identity(b)]
            else:
                a = self.arg(i.expr, env)
                name = fresh("g")
                df = df.withColumn(name, a.col)
                group.append(name)
                scope[i.name] = Value(name, a.type)
                swap[repr(i.expr)] = (col(name), a.type)
        env = Env(df, state.scope, {}, env.swap)
        aggs, types = [], {}
        self.discs: dict[str, Column] = {}
        for key, (name, f) in found.items():
            c, t, default = self.agg_column(f, env, state, weight)
            aggs.append(c.alias(name))
            types[name] = (t, default)
            swap[key] = (F.coalesce(col(name), default) if default is not None else col(name), t)
        if self.discs:
            df = df.withColumns(self.discs)
        group = list(dict.fromkeys([*state.corr, *group]))
        firsts = [F.first(col(c)).alias(c) for c in dict.fromkeys(firsts) if c not in group]
        grouped = df.groupBy(*(col(g) for g in group)).agg(*aggs, *firsts) if group else df.agg(*aggs)
        if state.corr and set(group) == set(state.corr) and state.outer is not None:
            # an outer row without matches still has its empty aggregate
            o = state.outer.select(*(col(c).alias(f"{c}_o") for c in state.corr))
            on = F.lit(True)
            for c in state.corr:
                on = on & col(f"{c}_o").eqNullSafe(col(c))
            grouped = o.join(grouped, on, "left").select(*(col(f"{c}_o").alias(c) for c in state.corr), *(col(c) for c in grouped.columns if c not in state.corr))
        after = {n: b for n, b in scope.items()}
        for i in keys:  # grouped entities stay readable under their old name
            if isinstance(i.expr, A.Var) and i.expr.name in state.scope:
                after.setdefault(i.expr.name, scope[i.name])
        env2 = Env(grouped, after, {}, env.swap | swap)
        cols = [col(c) for c in state.corr]
        final: dict[str, Binding] = {}
        for i in items:
            if i.name in scope:
                final[i.name] = scope[i.name]
                cols += [col(c) for c in scope[i.name].columns()]
                continue
            a = self.arg(i.expr, env2)
            name = fresh("c")
            cols.append(a.col.alias(name))
            final[i.name] = Value(name, a.type)
        order_cols = []
        for o in order:
            name = fresh("o")
            cols.append(self.sort_key(self.arg(self._expand_alias(o.expr, names), env2)).alias(name))
            order_cols.append((name, o.descending))
        uniq, seen = [], set()
        for c in cols:
            if str(c) not in seen:
                seen.add(str(c))
                uniq.append(c)
        return State(grouped.select(*uniq), final, order_cols, state.corr, state.outer), order_cols

    def agg_column(self, f: A.Func, env: Env, state: State, weight: str | None = None) -> tuple[Column, T.DataType, Column | None]:
        zero = F.lit(0).cast("long")
        count = lambda c: F.count(c) if weight is None else F.sum(F.when(c.isNotNull(), col(weight)))
        if f.star:
            return count(F.lit(1)), T.LongType(), zero
        if f.name.startswith("agg."):
            if f.name not in self.graph.aggregates:
                raise SemanticFault(f"unknown aggregate {f.name}()")
            c = self.graph.aggregates[f.name](*(self.arg(x, env) for x in f.args))
            return c, self.base(State(env.df)).agg(c.alias("x")).schema["x"].dataType, None
        first = f.args[0]
        if isinstance(first, A.Var) and isinstance(env.scope.get(first.name), (Node, Rel)):
            b = env.scope[first.name]
            if f.name == "count":
                ident = [col(c) for c in self._identity(b)]
                return (F.count_distinct(*ident) if f.distinct else count(ident[0])), T.LongType(), zero
        a = self.arg(first, env)
        c = a.col
        if f.name == "count":
            return (F.count_distinct(c) if f.distinct else count(c)), T.LongType(), zero
        if f.name == "count_if":
            return F.count_if(c if kind(a.type) == "boolean" else c != 0), T.LongType(), zero
        if f.name == "sum":
            t = T.LongType() if whole(a.type) else a.type if isinstance(a.type, T.DecimalType) else T.DoubleType()
            if is_duration(a.type):
                return F.struct(*(F.sum(c.getField(n)).alias(n) for n in a.type.fieldNames())), a.type, None
            if not numeric(a.type) and kind(a.type) != "null":
                raise TypeFault("sum() needs numbers")
            return (F.sum_distinct(c) if f.distinct else F.sum(c.cast(t))).cast(t), t, F.lit(0).cast(t)
        if f.name == "avg":
            return (F.sum_distinct(c.cast("double")) / F.count_distinct(c) if f.distinct else F.avg(c)), T.DoubleType(), None
        if f.name in ("min", "max"):
            return (F.min(c) if f.name == "min" else F.max(c)), a.type, None
        if f.name == "stdev":
            return F.stddev_samp(c.cast("double")), T.DoubleType(), F.lit(0.0)
        if f.name == "stdevp":
            return F.stddev_pop(c.cast("double")), T.DoubleType(), F.lit(0.0)
        if f.name in ("percentilecont", "percentiledisc"):
            p = self.constant(f.args[1])
            if not 0 <= p <= 1:
                raise ArgumentFault("a percentile lies between 0 and 1")
            if f.name == "percentilecont":
                return F.percentile(c.cast("double"), F.lit(float(p))), T.DoubleType(), None
            if not numeric(a.type):
                raise TypeFault("percentileDisc() needs numbers")
            return self._disc(c, float(p)).cast(a.type), a.type, None
        if f.name == "collect":
            t = T.ArrayType(a.type)
            keys = [(n, d) for n, d in state.order if n in env.df.columns]
            if f.distinct:
                if not keys:
                    return F.sort_array(F.collect_set(c)), t, F.array().cast(t)
                kept = self._ordered_list(c, keys)
                return F.array_distinct(kept), t, F.array().cast(t)
            return (self._ordered_list(c, keys) if keys else F.collect_list(c)), t, F.array().cast(t)
        if f.name == "json.array_agg":
            return F.to_json(F.transform(F.collect_list(F.struct(c.alias("v"))), lambda s: s["v"])), T.StringType(), F.lit("[]")
        if f.name == "json.object_agg":
            v = self.arg(f.args[1], env)
            return F.to_json(F.map_from_entries(F.collect_list(F.struct(c.cast("string"), v.col)))), T.StringType(), F.lit("{}")
        raise UnsupportedFault(f"aggregate {f.name}")

    def _disc(self, c: Column, p: float) -> Column:
        """The least value at or below which a share `p` lies: Spark's own aggregate, which counts equal values together."""
        name = fresh("d")
        self.discs[name] = c
        return F.expr(f"percentile_disc({p!r}D) WITHIN GROUP (ORDER BY `{name}`)")

    def _ordered_list(self, c: Column, keys: list[tuple[str, bool]]) -> Column:
        """collect() in the order of a preceding sort: Spark's own order of groups is not kept."""
        rows = F.collect_list(F.when(c.isNotNull(), F.struct(*(col(n).alias(f"k{i}") for i, (n, _) in enumerate(keys)), c.alias("v"))))

        def by(x: Column, y: Column) -> Column:
            out = F.lit(0)
            for i, (_, down) in reversed(list(enumerate(keys))):
                a, b = x[f"k{i}"], y[f"k{i}"]
                less, more = (F.lit(1), F.lit(-1)) if down else (F.lit(-1), F.lit(1))
                out = (
                    F.when(a.isNull() & b.isNull(), out).when(a.isNull(), more).when(b.isNull(), less)
                    .when(a < b, less).when(a > b, more).otherwise(out)
                )
            return out

        return F.transform(F.array_sort(rows, by), lambda s: s["v"])

    # === expressions =======================================================================

    def arg(self, e: A.Expr, env: Env) -> Arg:
        key = repr(e)
        if key in env.swap:
            c, t = env.swap[key]
            return Arg(c, t)
        m = getattr(self, f"_{type(e).__name__.lower()}", None)
        if m is None:
            raise UnsupportedFault(f"{type(e).__name__} here")
        return m(e, env)

    def typed(self, c: Column, env: Env) -> T.DataType:
        """The type of a column, by analysis; lambda variables are never in `c` here."""
        df = env.df if env.df is not None else self.spark.range(1)
        return df.select(c.alias("x")).schema["x"].dataType

    def constant_arg(self, v: Any) -> Arg:
        if v is None:
            return Arg(V.null(), T.NullType(), None, True)
        if isinstance(v, bool):
            return Arg(F.lit(v), T.BooleanType(), v, True)
        if isinstance(v, int):
            if not -(1 << 63) <= v < 1 << 63:
                raise ArgumentFault("integer out of range")
            return Arg(F.lit(v).cast("long"), T.LongType(), v, True)
        if isinstance(v, float):
            return Arg(F.lit(v), T.DoubleType(), v, True)
        if isinstance(v, str):
            return Arg(F.lit(v), T.StringType(), v, True)
        if isinstance(v, (list, tuple)):
            return self.list_of([self.constant_arg(x) for x in v], list(v))
        if isinstance(v, dict):
            parts = {k: self.constant_arg(x) for k, x in v.items()}
            return self.map_of(parts)
        c = F.lit(v)
        return Arg(c, self.spark.range(1).select(c.alias("x")).schema["x"].dataType, v, True)

    def list_of(self, xs: list[Arg], values: list[Any] | None = None) -> Arg:
        if not xs:
            return Arg(F.array().cast("array<void>"), T.ArrayType(T.NullType()), [], True)
        kinds = {kind(x.type) for x in xs} - {"null"}
        if len(kinds) > 1:
            raise UnsupportedFault(f"a list of {sorted(kinds)} in one column")
        t = next((x.type for x in xs if kind(x.type) != "null"), T.NullType())
        if kinds == {"number"} and any(fraction(x.type) for x in xs):
            t = T.DoubleType()
        elif kinds == {"number"} and all(whole(x.type) or kind(x.type) == "null" for x in xs):
            t = T.LongType()
        plain = all(x.constant for x in xs)
        vals = [x.value for x in xs] if plain and values is None else values
        cols = [x.col.cast(t) if x.type != t else x.col for x in xs]
        return Arg(F.array(*cols), T.ArrayType(t), vals if plain and None not in (vals or []) else None, plain)

    def map_of(self, parts: dict[str, Arg]) -> Arg:
        if not parts:
            return Arg(F.struct(), T.StructType([]))
        return Arg(F.struct(*(a.col.alias(k) for k, a in parts.items())), T.StructType([T.StructField(k, a.type) for k, a in parts.items()]))

    def _lit(self, e: A.Lit, env: Env) -> Arg:
        return self.constant_arg(e.value)

    def _param(self, e: A.Param, env: Env) -> Arg:
        return self.constant_arg(self.param(e.name))

    def _var(self, e: A.Var, env: Env) -> Arg:
        if e.name in env.locals:
            return Arg(*env.locals[e.name])
        b = env.scope.get(e.name)
        if b is None:
            raise SemanticFault(f"variable {e.name!r} is not defined")
        if isinstance(b, Value):
            return Arg(col(b.column), b.type)
        c = self.value_of(b, env.scope)
        return Arg(c, self.typed(c, env) if env.df is not None else self.value_type(b, env.scope))

    def value_of(self, b: Binding, scope: dict[str, Binding] | None = None) -> Column:
        """An entity as one struct value; null where an optional pattern found none."""
        if isinstance(b, Value):
            return col(b.column)
        if isinstance(b, Node):
            props = F.struct(*(col(c).alias(p) for p, (c, _) in b.props.items())) if b.props else F.struct(F.lit(None).cast("string").alias("_"))
            return F.when(col(b.key).isNotNull(), F.struct(col(b.key).alias("_key"), col(b.label).alias("_label"), props.alias("properties")))
        if isinstance(b, Rel):
            return F.when(col(b.id).isNotNull(), self.step_struct(b, True))
        if isinstance(b, RelList):
            return col(b.column)
        nodes, rels, fields = [], None, self.rel_fields(b, scope)
        text = ("_type", "_id", "_source", "_target")
        for n, before in zip(b.items, (None, *b.items), strict=False):
            x, walk = scope[n], scope.get(before)
            if isinstance(x, Node):
                one = F.array(self.node_value(x, b.fields))
                # a walk of no step ends where it began
                nodes.append(F.when(F.size(col(walk.column)) > 0, one).otherwise(F.slice(one, 1, 0)) if isinstance(walk, RelList) else one)
            elif isinstance(x, Rel):
                ident = F.lit(None) if b.plain else col(x.id)
                one = F.array(F.struct(col(x.type).alias("_type"), *(c.cast("string").alias(t) for t, c in zip(text[1:], (ident, col(x.source), col(x.target)), strict=True)), self.props_struct(x.props, fields).alias("properties")))
                rels = one if rels is None else F.concat(rels, one)
            else:
                some = self._plain_steps(x, fields)
                rels = some if rels is None else F.concat(rels, some)
                nodes.append(F.slice(col(x.between), F.lit(1), F.greatest(F.lit(0), F.size(col(x.between)) - 1)))
        if rels is None:
            rels = F.array().cast("array<struct<_type:string,_id:string,_source:string,_target:string,properties:struct<_:string>>>")
        return F.struct(F.concat(*nodes).alias("nodes"), rels.alias("relationships"))

    def _plain_steps(self, x: RelList, fields: dict[str, T.DataType]) -> Column:
        """The relationships of a walk as elements with the wanted properties."""

        def one(s: Column) -> Column:
            props = [(s["properties"][p].cast(t) if p in x.props else F.lit(None).cast(t)).alias(p) for p, t in fields.items()]
            names = ("_type", "_id", "_source", "_target")
            return F.struct(*(s[n].alias(n) for n in names), F.struct(*(props or [F.lit(None).cast("string").alias("_")])).alias("properties"))

        return F.transform(col(x.column), one)

    def rel_fields(self, b: Path, scope: dict[str, Binding]) -> dict[str, T.DataType]:
        out: dict[str, T.DataType] = {}
        for n in b.items:
            x = scope[n]
            props = {p: t for p, (_, t) in x.props.items()} if isinstance(x, Rel) else x.props if isinstance(x, RelList) else {}
            for p, t in props.items():
                if self.whole or p in self.keys:
                    out[p] = joint(out.get(p), t)
        return out

    def value_type(self, b: Binding, scope: dict[str, Binding]) -> T.DataType:
        if isinstance(b, Value):
            return b.type
        text = lambda *ns: [T.StructField(n, T.StringType()) for n in ns]
        props = lambda p: T.StructField("properties", T.StructType([T.StructField(k, t) for k, t in p.items()] or text("_")))
        plain = lambda p: {k: t for k, (_, t) in p.items()}
        if isinstance(b, Node):
            return T.StructType([T.StructField("_key", T.StringType() if not b.mappings else T.LongType()), *text("_label"), props(plain(b.props))])
        step = lambda p: T.StructType([*text("_type", "_id", "_source", "_target"), props(p)])
        if isinstance(b, Rel):
            return step(plain(b.props))
        if isinstance(b, RelList):
            return T.ArrayType(step(b.props))
        node = T.StructType([*text("_key", "_label"), props(b.fields)])
        return T.StructType([T.StructField("nodes", T.ArrayType(node)), T.StructField("relationships", T.ArrayType(step(self.rel_fields(b, scope))))])

    def _prop(self, e: A.Prop, env: Env) -> Arg:
        if isinstance(e.owner, A.Var) and e.owner.name not in env.locals:
            b = env.scope.get(e.owner.name)
            if isinstance(b, (Node, Rel)):
                if e.key in b.props:
                    c, t = b.props[e.key]
                    return Arg(col(c), t)
                return Arg(V.null(), T.NullType())
        return self.field(self.arg(e.owner, env), e.key)

    def field(self, o: Arg, key: str) -> Arg:
        part = temporal.component(o, key)
        if part is not None:
            return Arg(part, T.LongType())
        if isinstance(o.type, T.StructType):
            fields = {f.name: f.dataType for f in o.type.fields}
            if "properties" in fields and ("_label" in fields or "_type" in fields):
                inner = {f.name: f.dataType for f in fields["properties"].fields if f.name != "_"}
                return Arg(o.col.getField("properties").getField(key), inner[key]) if key in inner else Arg(V.null(), T.NullType())
            if "_key" in fields and key not in fields:
                raise UnsupportedFault(f"property {key!r} of an element that has only its key here")
            return Arg(o.col.getField(key), fields[key]) if key in fields else Arg(V.null(), T.NullType())
        if isinstance(o.type, T.MapType):
            return Arg(F.try_element_at(o.col, F.lit(key)), o.type.valueType)
        if kind(o.type) == "null":
            return Arg(V.null(), T.NullType())
        raise TypeFault(f"a {kind(o.type)} has no properties")

    def _index(self, e: A.Index, env: Env) -> Arg:
        o, i = self.arg(e.owner, env), self.arg(e.at, env)
        if isinstance(o.type, T.StructType) and i.constant and isinstance(i.value, str):
            return self.field(o, i.value)
        t = o.type.elementType if isinstance(o.type, T.ArrayType) else o.type.valueType if isinstance(o.type, T.MapType) else T.NullType()
        return Arg(V.index(o, i), t)

    def _slice(self, e: A.Slice, env: Env) -> Arg:
        o = self.arg(e.owner, env)
        lo = self.arg(e.low, env) if e.low is not None else None
        hi = self.arg(e.high, env) if e.high is not None else None
        return Arg(V.piece(o, lo, hi), o.type)

    def _bin(self, e: A.Bin, env: Env) -> Arg:
        a, b = self.arg(e.left, env), self.arg(e.right, env)
        yes = T.BooleanType()
        if e.op in ("AND", "OR", "XOR"):
            for x in (a, b):
                if kind(x.type) not in ("boolean", "null"):
                    raise TypeFault(f"{e.op} needs booleans")
            x, y = a.col.cast("boolean"), b.col.cast("boolean")
            return Arg(x & y if e.op == "AND" else x | y if e.op == "OR" else (x & ~y) | (~x & y), yes)
        if e.op in ("=", "<>"):
            same = self.entity_equal(e, env)
            if same is None:
                same = self.element_equal(a, b)
            same = V.equal(a, b) if same is None else same
            return Arg(same if e.op == "=" else ~same, yes)
        if e.op in ("<", "<=", ">", ">="):
            return Arg(V.compare(e.op, a, b), yes)
        if e.op == "IN":
            return Arg(V.member(a, b), yes)
        if e.op in ("STARTS", "ENDS", "CONTAINS"):
            if kind(a.type) != "string" or kind(b.type) != "string":
                return Arg(V.null().cast("boolean"), yes)
            fn = {"STARTS": F.startswith, "ENDS": F.endswith, "CONTAINS": F.contains}[e.op]
            return Arg(fn(a.col, b.col), yes)
        if e.op == "=~":
            return Arg(F.regexp_like(a.col, F.concat(F.lit(r"\A(?:"), b.col, F.lit(r")\z"))), yes)
        return Arg(V.arithmetic(e.op, a, b), self.arithmetic_type(e.op, a, b))

    def arithmetic_type(self, op: str, a: Arg, b: Arg) -> T.DataType:
        ka, kb = kind(a.type), kind(b.type)
        if "null" in (ka, kb):
            return T.NullType()
        if "list" in (ka, kb) and op == "+":
            lists = [x.type for x in (a, b) if kind(x.type) == "list"]
            return next((t for t in lists if kind(t.elementType) != "null"), T.ArrayType((b if ka == "list" else a).type) if len(lists) == 1 else lists[0])
        if {ka, kb} & {"date", "timestamp", "duration"}:
            if ka == kb == "date":
                return T.LongType()
            if op == "-" and kb != "duration" and kb != "number":
                from ..sources.types import DURATION

                return DURATION
            return a.type if ka in ("date", "timestamp") else b.type if kb in ("date", "timestamp") else a.type
        if "string" in (ka, kb):
            return T.StringType()
        if op == "^":
            return T.DoubleType()
        if whole(a.type) and whole(b.type):
            return T.LongType()
        if isinstance(a.type, T.DecimalType) or isinstance(b.type, T.DecimalType):
            return self.typed(V.arithmetic(op, Arg(V.null().cast(a.type), a.type), Arg(V.null().cast(b.type), b.type)), Env(None, {}))
        return T.DoubleType()

    def element_equal(self, a: Arg, b: Arg) -> Column | None:
        """Elements are equal by identity, whatever properties their values carry."""
        if not (isinstance(a.type, T.StructType) and isinstance(b.type, T.StructType)):
            return None
        for x, y in (("_key", "_label"), ("_id", "_type")):
            if all({x, y} <= set(t.fieldNames()) for t in (a.type, b.type)):
                return (a.col[x].cast("string") == b.col[x].cast("string")) & (a.col[y] == b.col[y])
        return None

    def entity_equal(self, e: A.Bin, env: Env) -> Column | None:
        got = [env.scope.get(x.name) if isinstance(x, A.Var) and x.name not in env.locals else None for x in (e.left, e.right)]
        if all(isinstance(b, Node) for b in got):
            a, b = got
            same = col(a.key).cast("string") == col(b.key).cast("string")
            return same & (col(a.label) == col(b.label))
        if all(isinstance(b, Rel) for b in got):
            a, b = got
            return (col(a.type) == col(b.type)) & (col(a.id).cast("string") == col(b.id).cast("string"))
        return None

    def _un(self, e: A.Un, env: Env) -> Arg:
        if e.op in ("IS NULL", "IS NOT NULL") and isinstance(e.arg, A.Var) and isinstance(env.scope.get(e.arg.name), (Node, Rel)):
            b = env.scope[e.arg.name]
            c = col(b.key if isinstance(b, Node) else b.id)
            return Arg(c.isNull() if e.op == "IS NULL" else c.isNotNull(), T.BooleanType())
        a = self.arg(e.arg, env)
        if e.op == "NOT":
            if kind(a.type) not in ("boolean", "null"):
                raise TypeFault("NOT needs a boolean")
            return Arg(~a.col.cast("boolean"), T.BooleanType())
        if e.op == "IS NULL":
            return Arg(a.col.isNull(), T.BooleanType())
        if e.op == "IS NOT NULL":
            return Arg(a.col.isNotNull(), T.BooleanType())
        return Arg(-V.wide(a), T.LongType() if whole(a.type) else a.type)

    def _listlit(self, e: A.ListLit, env: Env) -> Arg:
        return self.list_of([self.arg(x, env) for x in e.items])

    def _maplit(self, e: A.MapLit, env: Env) -> Arg:
        return self.map_of({k: self.arg(x, env) for k, x in e.items})

    def _case(self, e: A.Case, env: Env) -> Arg:
        subject = self.arg(e.subject, env) if e.subject is not None else None
        outs = [self.arg(t, env) for _, t in e.whens] + ([self.arg(e.default, env)] if e.default is not None else [])
        kinds = {kind(o.type) for o in outs} - {"null"}
        if len(kinds) > 1:
            raise UnsupportedFault(f"a CASE with results of {sorted(kinds)}")
        t = next((o.type for o in outs if kind(o.type) != "null"), T.NullType())
        if kinds == {"number"}:
            t = T.DoubleType() if any(fraction(o.type) for o in outs) else T.LongType()
        c = None
        for (w, _), o in zip(e.whens, outs, strict=False):
            test = self.arg(w, env)
            cond = V.equal(subject, test) if subject is not None else test.col.cast("boolean")
            value = o.col.cast(t) if o.type != t else o.col
            c = F.when(cond, value) if c is None else c.when(cond, value)
        if e.default is not None:
            c = c.otherwise(outs[-1].col.cast(t) if outs[-1].type != t else outs[-1].col)
        return Arg(c, t)

    def items(self, e: A.Expr, env: Env) -> Arg:
        a = self.arg(e, env)
        if kind(a.type) == "null":
            return Arg(V.null().cast("array<string>"), T.ArrayType(T.StringType()))
        if not isinstance(a.type, T.ArrayType):
            raise TypeFault("a list is needed")
        if kind(a.type.elementType) == "null":
            return Arg(a.col.cast("array<string>"), T.ArrayType(T.StringType()))
        return a

    def _inner(self, e: A.Expr, var: str, t: T.DataType, env: Env) -> T.DataType:
        """The type of a lambda's body, from a placeholder for its variable."""
        return self.arg(e, env.bind(**{var: (F.lit(None).cast(t), t)})).type

    def _listcomp(self, e: A.ListComp, env: Env) -> Arg:
        xs = self.items(e.source, env)
        t = xs.type.elementType
        c = xs.col
        if e.where is not None:
            c = F.filter(c, lambda x: self.arg(e.where, env.bind(**{e.var: (x, t)})).col.cast("boolean"))
        if e.out is None:
            return Arg(c, xs.type)
        out = self._inner(e.out, e.var, t, env)
        return Arg(F.transform(c, lambda x: self.arg(e.out, env.bind(**{e.var: (x, t)})).col), T.ArrayType(out))

    def _quant(self, e: A.Quant, env: Env) -> Arg:
        xs = self.items(e.source, env)
        t = xs.type.elementType
        test = lambda x: self.arg(e.where, env.bind(**{e.var: (x, t)})).col.cast("boolean")
        if e.kind == "all":
            c = F.forall(xs.col, test)
        elif e.kind == "any":
            c = F.exists(xs.col, test)
        elif e.kind == "none":
            c = ~F.exists(xs.col, test)
        else:
            yes = F.size(F.filter(xs.col, test))
            unknown = F.size(F.filter(xs.col, lambda x: test(x).isNull()))
            c = F.when(xs.col.isNull(), None).when(yes > 1, F.lit(False)).when(unknown > 0, None).otherwise(yes == 1)
        return Arg(c, T.BooleanType())

    def _reduce(self, e: A.Reduce, env: Env) -> Arg:
        xs, init = self.items(e.source, env), self.arg(e.init, env)
        t, at = xs.type.elementType, init.type
        both = lambda a, x: env.bind(**{e.acc: (a, at), e.var: (x, t)})
        out = self.arg(e.body, both(F.lit(None).cast(at), F.lit(None).cast(t))).type
        if out != at:
            at = out
        return Arg(F.aggregate(xs.col, init.col.cast(at), lambda a, x: self.arg(e.body, both(a, x)).col.cast(at)), at)

    def _haslabels(self, e: A.HasLabels, env: Env) -> Arg:
        b = env.scope.get(e.owner.name)
        if isinstance(b, Node):
            return Arg(F.when(col(b.key).isNotNull(), self.has_labels(b, e.labels)), T.BooleanType())
        if isinstance(b, Rel) and e.labels[0] == "is":
            return Arg(col(b.type) == F.lit(e.labels[1]), T.BooleanType())
        raise TypeFault("a label test needs a node or relationship")

    def _sub(self, e: A.Sub, env: Env) -> Arg:
        raise UnsupportedFault("a subquery inside a list expression")

    _patterncomp = _sub

    def _func(self, e: A.Func, env: Env) -> Arg:
        if is_aggregate(e):
            raise SemanticFault(f"{e.name}() is not allowed here")
        got = self.entity_function(e, env)
        if got is not None:
            return got
        args: list[Arg] = []
        e = self.positional(e)
        for x in e.args:
            if isinstance(x, A.Lambda):
                args.append(self.lambda_arg(x, args[0], env))
            else:
                args.append(self.arg(x, env))
        c = registry.build(e.name, args, self.graph.functions)
        return Arg(c, self.function_type(e, args, env))

    def positional(self, e: A.Func) -> A.Func:
        """Arguments given by name, in the function's own order."""
        if not any(isinstance(x, A.Named) for x in e.args):
            return e
        names = registry.PARAMETERS.get(e.name)
        if names is None:
            raise ArgumentFault(f"{e.name}() has no named arguments")
        out: dict[str, A.Expr] = {}
        for i, x in enumerate(e.args):
            name = x.name if isinstance(x, A.Named) else names[i] if i < len(names) else ""
            if name not in names or name in out:
                raise ArgumentFault(f"{e.name}() takes {', '.join(names)}, each once")
            out[name] = x.value if isinstance(x, A.Named) else x
        given = [n in out for n in names]
        if given != sorted(given, reverse=True):
            raise ArgumentFault(f"{e.name}() lacks {names[given.index(False)]}")
        import dataclasses

        return dataclasses.replace(e, args=tuple(out[n] for n in names if n in out))

    def lambda_arg(self, x: A.Lambda, xs: Arg, env: Env) -> Arg:
        t = xs.type.elementType if isinstance(xs.type, T.ArrayType) else T.NullType()
        names = x.params

        def fn(*cols: Column) -> Column:
            return self.arg(x.body, env.bind(**{n: (c, t) for n, c in zip(names, cols, strict=False)})).col

        if len(names) == 1:
            return Arg(V.null(), T.NullType(), fn=lambda v: fn(v))
        return Arg(V.null(), T.NullType(), fn=lambda a, b: fn(a, b))

    def function_type(self, e: A.Func, args: list[Arg], env: Env) -> T.DataType:
        """Known types of common functions; else the type of a call on typed nulls."""
        holders = []
        for a in args:
            if a.fn is not None or a.constant:
                holders.append(a)
            else:
                holders.append(Arg(F.lit(None).cast(a.type) if not isinstance(a.type, T.NullType) else V.null(), a.type, a.value, a.constant))
        c = registry.build(e.name, holders, self.graph.functions)
        return self.typed(c, Env(None, {}) if not any(a.fn for a in args) else env)

    def labels_of(self, tag: Column, mappings: tuple[NodeMapping, ...], n: str) -> Arg:
        """The first label, or all of them, of the table that a tag names."""
        if n in ("label", "cypher_label"):
            if all(m.tag == m.label for m in mappings):
                return Arg(tag, T.StringType())
            of = lambda m: F.lit(m.label)
        else:
            of = lambda m: F.array(*(F.lit(x) for x in m.labels)).cast("array<string>")
        c = F.lit(None)
        for m in mappings:
            c = F.when(tag == m.tag, of(m)).otherwise(c)
        return Arg(c, T.StringType() if n in ("label", "cypher_label") else T.ArrayType(T.StringType()))

    def entity_function(self, e: A.Func, env: Env) -> Arg | None:
        """Functions of nodes, relationships and paths."""
        b = None
        if e.args and isinstance(e.args[0], A.Var) and e.args[0].name not in env.locals:
            b = env.scope.get(e.args[0].name)
        text = T.StringType()
        n = e.name
        if isinstance(b, Node):
            if n in ("id", "internal_id", "cypher_id", "rowid"):
                return Arg(col(b.key), self.typed(col(b.key), env))
            if n == "elementid":
                return Arg(F.concat_ws(":", col(b.label), col(b.key).cast("string")), text)
            if n in ("label", "cypher_label", "labels", "cypher_labels"):
                got = self.labels_of(col(b.label), b.mappings, n)
                return Arg(F.when(col(b.key).isNotNull(), got.col), got.type)
            if n in ("properties", "property_map"):
                v = self.value_of(b).getField("properties")
                return Arg(v, T.StructType([T.StructField(k, t) for k, (_, t) in b.props.items()]))
            if n == "exists":
                return Arg(col(b.key).isNotNull(), T.BooleanType())
        if isinstance(b, Rel):
            if n in ("id", "internal_id", "cypher_id", "rowid", "elementid"):
                return Arg(col(b.id), self.typed(col(b.id), env))
            if n in ("type", "label", "cypher_type"):
                return Arg(F.when(col(b.id).isNotNull(), col(b.type)), text)
            if n in STARTS | ENDS:  # inside a list expression or an aggregate: the key alone
                c = col(b.source if n in STARTS else b.target)
                return Arg(F.struct(c.alias("_key")), T.StructType([T.StructField("_key", self.typed(c, env))]))
            if n in ("properties", "property_map"):
                return Arg(self.value_of(b).getField("properties"), T.StructType([T.StructField(k, t) for k, (_, t) in b.props.items()]))
        if isinstance(b, (Path, RelList)):
            v = self.arg(e.args[0], env)
            if isinstance(b, RelList):
                if n in ("length", "size"):
                    return Arg(F.size(v.col).cast("long"), T.LongType())
                return None
            if n == "length":
                return Arg(F.size(v.col.getField("relationships")).cast("long"), T.LongType())
            if n in ("nodes", "cypher_nodes"):
                return Arg(v.col.getField("nodes"), v.type["nodes"].dataType)
            if n in ("relationships", "rels", "cypher_relationships"):
                return Arg(v.col.getField("relationships"), v.type["relationships"].dataType)
            if n in ("is_trail", "is_acyclic"):
                items = v.col.getField("relationships" if n == "is_trail" else "nodes")
                return Arg(F.size(F.array_distinct(items)) == F.size(items), T.BooleanType())
        if n in ("type", "label", "labels", "id") and len(e.args) == 1 and b is None:
            a = self.arg(e.args[0], env)
            if isinstance(a.type, T.StructType):
                names = a.type.fieldNames()
                if n in ("label", "labels") and "_label" in names:
                    return self.labels_of(a.col.getField("_label"), self.graph.nodes, n)
                field_ = {"type": "_type", "label": "_type" if "_type" in names else "_label", "id": "_id" if "_id" in names else "_key"}[n]
                if field_ in names:
                    return Arg(a.col.getField(field_), a.type[field_].dataType)
        return None
