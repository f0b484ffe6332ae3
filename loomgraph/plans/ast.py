"""Syntax trees of Cypher queries."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Expr:
    pass


@dataclass(frozen=True)
class Lit(Expr):
    value: Any


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Var(Expr):
    name: str


@dataclass(frozen=True)
class Prop(Expr):
    owner: Expr
    key: str


@dataclass(frozen=True)
class Index(Expr):
    owner: Expr
    at: Expr


@dataclass(frozen=True)
class Slice(Expr):
    owner: Expr
    low: Expr | None
    high: Expr | None


@dataclass(frozen=True)
class Bin(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Un(Expr):
    op: str
    arg: Expr


@dataclass(frozen=True)
class Func(Expr):
    name: str
    args: tuple[Expr, ...]
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Lambda(Expr):
    params: tuple[str, ...]
    body: Expr


@dataclass(frozen=True)
class ListLit(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class MapLit(Expr):
    items: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Case(Expr):
    subject: Expr | None
    whens: tuple[tuple[Expr, Expr], ...]
    default: Expr | None


@dataclass(frozen=True)
class ListComp(Expr):
    var: str
    source: Expr
    where: Expr | None
    out: Expr | None


@dataclass(frozen=True)
class Quant(Expr):
    kind: str
    var: str
    source: Expr
    where: Expr


@dataclass(frozen=True)
class Reduce(Expr):
    acc: str
    init: Expr
    var: str
    source: Expr
    body: Expr


@dataclass(frozen=True)
class HasLabels(Expr):
    owner: Expr
    labels: Any


@dataclass(frozen=True)
class NodePat:
    var: str | None
    labels: Any  # None or a label tree: ("is", name), ("and"|"or", [..]), ("not", tree)
    props: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class RelPat:
    var: str | None
    types: tuple[str, ...]
    direction: str  # "out", "in", "both"
    props: tuple[tuple[str, Expr], ...]
    low: int | None = None
    high: int | None = None
    variable: bool = False
    step_vars: tuple[str, str] | None = None
    step_where: Expr | None = None
    mode: str | None = None  # of a variable length: TRAIL, WALK, SIMPLE, ACYCLIC, SHORTEST, ALL SHORTEST


@dataclass(frozen=True)
class Part:
    path: str | None
    items: tuple[Any, ...]  # node, rel, node, ...
    selector: str | None = None  # None, "shortest", "all_shortest"


@dataclass(frozen=True)
class Named(Expr):
    """An argument given by name."""

    name: str
    value: Expr


@dataclass(frozen=True)
class PatternComp(Expr):
    part: Part
    where: Expr | None
    out: Expr


@dataclass(frozen=True)
class Sub(Expr):
    """EXISTS { } or COUNT { } or COLLECT { }: patterns with WHERE, or a whole query."""

    kind: str
    parts: tuple[Part, ...]
    where: Expr | None
    query: Any = None


@dataclass(frozen=True)
class Item:
    expr: Expr
    name: str


@dataclass(frozen=True)
class Order:
    expr: Expr
    descending: bool


@dataclass(frozen=True)
class Projection:
    items: tuple[Item, ...]
    star: bool
    distinct: bool
    order: tuple[Order, ...]
    skip: Expr | None
    limit: Expr | None
    where: Expr | None = None


@dataclass(frozen=True)
class Match:
    parts: tuple[Part, ...]
    where: Expr | None
    optional: bool


@dataclass(frozen=True)
class Unwind:
    source: Expr
    var: str


@dataclass(frozen=True)
class With:
    body: Projection


@dataclass(frozen=True)
class Return:
    body: Projection


@dataclass(frozen=True)
class CallSub:
    query: Any


@dataclass(frozen=True)
class CallProc:
    name: str
    args: tuple[Expr, ...] | None
    yields: tuple[tuple[str, str], ...] | None
    where: Expr | None
    standalone: bool = False


@dataclass(frozen=True)
class Create:
    parts: tuple[Part, ...]


@dataclass(frozen=True)
class SetItem:
    kind: str  # "prop", "replace", "merge", "labels"
    target: Expr
    value: Any


@dataclass(frozen=True)
class Merge:
    part: Part
    on_create: tuple[SetItem, ...] = ()
    on_match: tuple[SetItem, ...] = ()


@dataclass(frozen=True)
class SetClause:
    items: tuple[SetItem, ...]


@dataclass(frozen=True)
class Remove:
    items: tuple[SetItem, ...]


@dataclass(frozen=True)
class Delete:
    targets: tuple[Expr, ...]
    detach: bool


@dataclass(frozen=True)
class Single:
    clauses: tuple[Any, ...]


@dataclass(frozen=True)
class Query:
    parts: tuple[Single, ...]
    all: tuple[bool, ...] = field(default=())  # UNION ALL flags between parts
