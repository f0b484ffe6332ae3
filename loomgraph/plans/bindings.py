"""What a query's variables stand for: flat columns of the current DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.mapping import NodeMapping


def col(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass
class Value:
    """A plain value in one column."""

    column: str
    type: T.DataType

    def columns(self) -> list[str]:
        return [self.column]


@dataclass
class Node:
    """A node: key, label and property columns. `mappings` are the tables it may come from."""

    key: str
    label: str
    mappings: tuple[NodeMapping, ...]
    props: dict[str, tuple[str, T.DataType]] = field(default_factory=dict)
    #: foreign keys that its own row holds, by edge index
    held: dict[int, str] = field(default_factory=dict)

    def columns(self) -> list[str]:
        return [self.key, self.label, *(c for c, _ in self.props.values()), *self.held.values()]

    @property
    def single(self) -> bool:
        return len({m.tag for m in self.mappings}) == 1


@dataclass
class Rel:
    """A relationship: type, identity, ends and property columns."""

    type: str
    id: str
    source: str
    target: str
    types: tuple[str, ...]
    props: dict[str, tuple[str, T.DataType]] = field(default_factory=dict)
    ends: tuple[str, str] | None = None  # label columns of source and target
    #: type, table, source and target label of the relationships it may be; None: not known
    homes: set[tuple[str, str, str, str]] | None = None

    def columns(self) -> list[str]:
        return [self.type, self.id, self.source, self.target, *(self.ends or ()), *(c for c, _ in self.props.values())]


@dataclass
class RelList:
    """The relationships of a variable-length pattern: an array of structs, and the nodes between."""

    column: str
    between: str
    #: types of the properties that the relationships, and the nodes between, carry
    props: dict[str, T.DataType] = field(default_factory=dict)
    fields: dict[str, T.DataType] = field(default_factory=dict)

    def columns(self) -> list[str]:
        return [self.column, self.between]


@dataclass
class Path:
    """A path: names of its parts in the scope."""

    items: tuple[str, ...]
    #: node properties that its value carries
    fields: dict[str, T.DataType] = field(default_factory=dict)
    #: whether its relationships go without their identities
    plain: bool = False

    def columns(self) -> list[str]:
        return []


Binding = Value | Node | Rel | RelList | Path
