"""A catalog of mappings: numbered snapshots, changed only from the revision a caller has seen."""

from __future__ import annotations

import dataclasses
import json
import threading
from typing import Any

from pyspark.sql import SparkSession

from .errors import ConstraintFault, SemanticFault
from .graph import Graph
from .sources.mapping import ComputedMapping, EdgeMapping, Mapping, NodeMapping, from_dict, to_dict


@dataclasses.dataclass(frozen=True)
class Snapshot:
    revision: int
    mapping: Mapping


class Catalog:
    """Mappings over named tables. Every change makes a new revision; earlier snapshots stay as they are."""

    def __init__(self, spark: SparkSession, mapping: Mapping, tables: dict[str, Any] | None = None, **graph_options: Any):
        self.spark, self.tables, self.options = spark, dict(tables or {}), graph_options
        self._now, self._lock = Snapshot(0, mapping.check()), threading.Lock()

    def snapshot(self) -> Snapshot:
        return self._now

    def graph(self, at: Snapshot | None = None) -> Graph:
        """A graph over a snapshot, the current one by default."""
        return Graph(self.spark, (at or self._now).mapping, self.tables, **self.options)

    def _change(self, seen: int, make: Any) -> Snapshot:
        with self._lock:
            if seen != self._now.revision:
                raise ConstraintFault(f"the catalog is at revision {self._now.revision}, not {seen}")
            self._now = Snapshot(seen + 1, make(self._now.mapping).check())
            return self._now

    def register(self, what: NodeMapping | EdgeMapping | ComputedMapping, seen: int) -> Snapshot:
        """Add a mapping; relationships that come to depend on each other in a circle are refused."""
        section = {NodeMapping: "nodes", EdgeMapping: "edges", ComputedMapping: "computed"}.get(type(what))
        if section is None:
            raise SemanticFault("a node, edge or computed mapping is needed")
        return self._change(seen, lambda m: dataclasses.replace(m, **{section: (*getattr(m, section), what)}))

    def save(self, path: str) -> None:
        """Write the current snapshot as one JSON line below `path`, a folder that any store of Spark's may hold."""
        now = self._now
        line = json.dumps({"revision": now.revision, "mapping": to_dict(now.mapping)})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, tables: dict[str, Any] | None = None, **graph_options: Any) -> Catalog:
        """The catalog that `save` wrote, at its revision."""
        doc = json.loads(spark.read.text(path).first()["value"])
        out = cls(spark, from_dict(doc["mapping"]), tables, **graph_options)
        out._now = Snapshot(doc["revision"], out._now.mapping)
        return out

    def remove(self, type_: str, seen: int) -> Snapshot:
        """Remove all relationships of a type, unless another one is made from it."""
        return self._change(seen, lambda m: m.without(type_))
