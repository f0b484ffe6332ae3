"""The schema mapping: tables, and how their rows are nodes and relationships."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field, fields
from typing import Any

from ..errors import SemanticFault


@dataclass(frozen=True)
class NodeMapping:
    """Rows of `table` are nodes of `label`; `key` identifies one, columns become properties."""

    label: str
    table: str
    key: tuple[str, ...]
    properties: dict[str, str]
    extra_labels: tuple[str, ...] = ()
    #: SQL text over the registered tables that stands for `table`, and a filter on its rows.
    query: str | None = None
    where: str | None = None
    #: rows of a list: {"column" or "expr", "as", optionally "ordinality" and "outer"}, one row an item
    collection: dict[str, Any] | None = None
    #: what tells this table's nodes from all others and names it in edges; the label where not given
    name: str | None = None

    @property
    def tag(self) -> str:
        return self.label if self.name is None else self.name

    @property
    def labels(self) -> tuple[str, ...]:
        return tuple(x for x in (self.label, *self.extra_labels) if x)

    def __hash__(self) -> int:
        return hash((self.tag, self.table))


@dataclass(frozen=True)
class EdgeMapping:
    """Rows of `table` are relationships of `type` between two labels.

    An edge whose table is also that of one endpoint, keyed the same, is a foreign key held there.
    `id` names columns that tell parallel relationships apart; without it all columns do.
    """

    type: str
    table: str
    source: str
    target: str
    source_key: tuple[str, ...]
    target_key: tuple[str, ...]
    properties: dict[str, str] = field(default_factory=dict)
    id: tuple[str, ...] = ()
    query: str | None = None
    where: str | None = None
    #: as in NodeMapping: one relationship for each item of a list
    collection: dict[str, Any] | None = None
    #: every end is known to be a row of its node table, so a join to it may be left out
    enforced: bool = False

    def __hash__(self) -> int:
        return hash((self.type, self.table, self.source, self.target))


@dataclass(frozen=True)
class ComputedMapping:
    """A relationship that is worked out: `kind` is predicate, as_of, top_k, search or cypher.

    predicate: `options.on`, an expression over `a` and `b`.
    as_of: `options.source_time`, `target_time`, `partition` ([[source, target], ..]).
    top_k: `options.vector` ([source, target]), `k`, `measure`; the score is a property.
    search: `options.text` ([source, target]), `k`; BM25 with the source's text as the query.
    cypher: `options.query`, a statement that returns `source` and `target` keys and properties.
    """

    type: str
    source: str
    target: str
    kind: str
    options: dict[str, Any]

    def __hash__(self) -> int:
        return hash((self.type, self.source, self.target, self.kind))


@dataclass(frozen=True)
class Mapping:
    nodes: tuple[NodeMapping, ...] = ()
    edges: tuple[EdgeMapping, ...] = ()
    computed: tuple[ComputedMapping, ...] = ()

    def node(self, label: str) -> NodeMapping:
        for n in self.nodes:
            if n.tag == label:
                return n
        raise SemanticFault(f"no node mapping for label {label!r}")

    def without(self, type_: str) -> Mapping:
        """This mapping less every relationship of a type; refused while another one is made from it."""
        rest = tuple(c for c in self.computed if c.type != type_)
        users = sorted(c.type for c in rest if c.kind == "cypher" and type_ in types_of(c.options["query"]))
        if users:
            raise SemanticFault(f"{type_!r} is used by {users}")
        left = Mapping(self.nodes, tuple(e for e in self.edges if e.type != type_), rest)
        if len(left.edges) + len(left.computed) == len(self.edges) + len(self.computed):
            raise SemanticFault(f"no relationship {type_!r}")
        return left

    def _acyclic(self) -> None:
        """Relationships made from Cypher may use each other, but not in a circle."""
        uses = {}
        for c in self.computed:
            if c.kind == "cypher":
                uses.setdefault(c.type, set()).update(types_of(c.options["query"]))
        done: set[str] = set()

        def visit(t: str, above: tuple[str, ...]) -> None:
            if t in above:
                raise SemanticFault(f"relationships depend on each other: {' -> '.join((*above, t))}")
            if t not in done:
                for u in sorted(uses.get(t, ())):
                    visit(u, (*above, t))
                done.add(t)

        for t in sorted(uses):
            visit(t, ())

    def check(self) -> Mapping:
        seen = set()
        for n in self.nodes:
            if not n.key or len(set(n.key)) != len(n.key):
                raise SemanticFault(f"label {n.label!r} needs distinct key columns")
            if n.tag in seen:
                raise SemanticFault(f"{n.tag!r} is mapped twice; give one of the tables a name of its own")
            seen.add(n.tag)
        for e in (*self.edges, *self.computed):
            self.node(e.source), self.node(e.target)
        for m in (*self.nodes, *self.edges):
            c = m.collection
            if c is not None and (set(c) - {"column", "expr", "as", "ordinality", "outer"} or "as" not in c or ("column" in c) == ("expr" in c)):
                raise SemanticFault(f"a collection of {m.table!r} needs column or expr, and as; ordinality and outer may follow")
        self._acyclic()
        return self


def types_of(query: str) -> set[str]:
    """The relationship types that a query's patterns name."""
    from ..plans import ast, parser

    found: set[str] = set()

    def visit(e: Any) -> None:
        if isinstance(e, ast.RelPat):
            found.update(e.types)
        if isinstance(e, (tuple, list)):
            for x in e:
                visit(x)
        elif hasattr(e, "__dataclass_fields__"):
            for f in e.__dataclass_fields__:
                visit(getattr(e, f))

    visit(parser.parse(query))
    return found


def _tuple(value: Any) -> tuple[str, ...]:
    return (value,) if isinstance(value, str) else tuple(value or ())


def _build(kind: type, item: dict[str, Any]) -> Any:
    known = {f.name: f for f in fields(kind)}
    if extra := set(item) - set(known):
        raise SemanticFault(f"unknown fields {sorted(extra)} in {kind.__name__}")
    wide = {k: _tuple(v) if known[k].type == "tuple[str, ...]" else v for k, v in item.items()}
    if kind is NodeMapping:
        wide.setdefault("properties", {})
    return kind(**wide)


def from_dict(doc: dict[str, Any]) -> Mapping:
    """A mapping from its document form; unknown fields are refused."""
    if extra := set(doc) - {"nodes", "edges", "computed"}:
        raise SemanticFault(f"unknown sections {sorted(extra)}")
    return Mapping(
        tuple(_build(NodeMapping, n) for n in doc.get("nodes", ())),
        tuple(_build(EdgeMapping, e) for e in doc.get("edges", ())),
        tuple(_build(ComputedMapping, c) for c in doc.get("computed", ())),
    ).check()


def to_dict(mapping: Mapping) -> dict[str, Any]:
    """The document form of a mapping: what `from_dict` reads back."""

    def item(x: Any) -> dict[str, Any]:
        got = {f.name: getattr(x, f.name) for f in fields(x)}
        return {k: list(v) if isinstance(v, tuple) else v for k, v in got.items() if v not in (None, (), {})}

    return {s: [item(x) for x in getattr(mapping, s)] for s in ("nodes", "edges", "computed")}


def from_json(text: str) -> Mapping:
    return from_dict(json.loads(text))


def from_toml(text: str) -> Mapping:
    return from_dict(tomllib.loads(text))
