"""A managed graph: versioned Parquet tables that Cypher writes to.

Each statement reads one immutable version and, if it writes, makes the next one: changed tables are
written to new folders, and a manifest named after the revision is put into place last by a rename
that fails where the name is taken. So readers never see half a version, a crash leaves the earlier
one, and of two writers that began at one revision the second to commit fails. The version is the
manifest of the greatest number. Inside a transaction a statement that fails latches it: nothing but
a rollback is taken until then.

A table holds the nodes of one set of labels, so no set hides another; setting or removing a label
moves the node's row, and its relationships, to the tables of its new set.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ConstraintFault, SemanticFault, UnsupportedFault
from .graph import Graph
from .plans import ast as A
from .plans.bindings import Node, Rel, Value, col
from .plans.planner import Env, Planner, State, fresh
from .sources.mapping import EdgeMapping, Mapping, NodeMapping

ID = "_id"


class Store:
    """Node tables `n:<label>` (_id, properties) and edge tables `e:<type>:<source>:<target>`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.revision, self.tables = self._load()
        self.pending: dict[str, DataFrame] | None = None
        self.failed = False

    # --- versions ---

    def _fs(self, path: str) -> tuple[Any, Any]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _load(self) -> tuple[int, dict[str, str]]:
        fs, p = self._fs(f"{self.path}/manifests")
        if not fs.exists(p):
            return 0, {}
        names = (x.getPath().getName() for x in fs.listStatus(p))
        numbers = [int(n.split(".")[0]) for n in names if n.endswith(".json") and n.split(".")[0].isdigit()]
        if not numbers:
            return 0, {}
        rows = self.spark.read.text(f"{self.path}/manifests/{max(numbers):012d}.json", wholetext=True).collect()
        doc = json.loads("\n".join(r.value for r in rows))
        return doc["revision"], doc["tables"]

    def begin(self) -> None:
        if self.pending is not None:
            raise SemanticFault("a transaction is open already")
        self.pending, self.failed = {}, False

    def rollback(self) -> None:
        self.pending, self.failed = None, False

    def commit(self) -> int:
        """Write the pending tables and publish the next revision."""
        if self.failed:
            raise SemanticFault("a statement of this transaction failed; roll it back")
        pending, self.pending = self.pending or {}, None
        now, _ = self._load()
        if now != self.revision:
            raise ConstraintFault(f"revision {now} was committed meanwhile; this one began at {self.revision}")
        tables = dict(self.tables)
        for name, df in pending.items():
            where = f"{self.path}/data/{uuid.uuid4().hex}"
            df.write.parquet(where)
            tables[name] = where
        self._publish(self.revision + 1, json.dumps({"revision": self.revision + 1, "tables": tables}))
        self.revision, self.tables = self.revision + 1, tables
        return self.revision

    def _publish(self, number: int, doc: str) -> None:
        """Put a whole manifest into place unless its number is taken."""
        fs, tmp = self._fs(f"{self.path}/staged/{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        out.write(bytearray(doc.encode()))
        out.close()
        _, folder = self._fs(f"{self.path}/manifests")
        fs.mkdirs(folder)
        jvm = self.spark._jvm
        _, final = self._fs(f"{self.path}/manifests/{number:012d}.json")
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            files.rename(fs.makeQualified(tmp), fs.makeQualified(final), options)
        except Exception as e:
            fs.delete(tmp, False)
            raise ConstraintFault(f"revision {number} was committed meanwhile") from e

    def frame(self, name: str) -> DataFrame:
        if self.pending is not None and name in self.pending:
            return self.pending[name]
        return self.spark.read.parquet(self.tables[name])

    def names(self) -> list[str]:
        return sorted({*self.tables, *(self.pending or {})})

    # --- use ---

    def graph(self) -> Graph:
        """The current version as a graph."""
        nodes, edges, frames = [], [], {}
        for name in self.names():
            df = frames[name] = self.frame(name)
            kind, *rest = name.split(":")
            props = {c: c for c in df.columns if not c.startswith("_")}
            if kind == "n":
                labels = rest[0].split("&")
                nodes.append(NodeMapping(labels[0], name, (ID,), props, tuple(labels[1:]), name=rest[0]))
            else:
                edges.append(EdgeMapping(rest[0], name, rest[1], rest[2], ("_source",), ("_target",), props, (ID,), enforced=True))
        return Graph(self.spark, Mapping(tuple(nodes), tuple(edges)), frames, store=self)

    def cypher(self, text: str, **params: Any) -> DataFrame:
        """Run one statement; outside a transaction a write commits by itself."""
        auto = self.pending is None
        if self.failed:
            raise SemanticFault("a statement of this transaction failed; roll it back")
        if auto:
            self.pending = {}
        try:
            result = self.graph().cypher(text, **params)
            if auto and self.pending:
                self.commit()
            elif auto:
                self.pending = None
            return result
        except Exception:
            if auto:
                self.pending = None
            else:
                self.failed = True
            raise

    def writer(self, planner: Planner) -> Writer:
        return Writer(self, planner)


class Writer:
    """Applies updating clauses: each computes the rows it changes once and replaces the tables."""

    def __init__(self, store: Store, planner: Planner):
        self.store, self.planner = store, planner

    def apply(self, c: Any, state: State) -> State:
        if isinstance(c, A.Create):
            return self.create(c.parts, state)
        if isinstance(c, A.Merge):
            return self.merge(c, state)
        if isinstance(c, A.SetClause):
            return self.set(c.items, state)
        if isinstance(c, A.Remove):
            return self.set(tuple(A.SetItem("prop", i.target, A.Lit(None)) if i.kind == "prop" else i for i in c.items), state, remove=True)
        if isinstance(c, A.Delete):
            return self.delete(c, state)
        raise UnsupportedFault(type(c).__name__)

    def put(self, name: str, df: DataFrame) -> None:
        self.store.pending[name] = self.planner.graph.settle(df)
        self.refresh()

    def refresh(self) -> None:
        """Later clauses of the statement read what earlier ones wrote."""
        fresh_graph = self.store.graph()
        g = self.planner.graph
        g.mapping, g.tables = fresh_graph.mapping, fresh_graph.tables
        g._frames.clear()
        g._kinds.clear()

    def append(self, name: str, rows: DataFrame) -> None:
        if name in self.store.names():
            rows = self.store.frame(name).unionByName(rows, allowMissingColumns=True)
        self.put(name, rows)

    def settled(self, state: State) -> State:
        df = state.df if state.df is not None and state.df.columns else self.planner.spark.range(1).select(F.lit(1).alias(fresh("one")))
        return State(self.planner.graph.settle(df), state.scope, state.order, state.corr, state.outer)

    def create(self, parts: tuple[A.Part, ...], state: State) -> State:
        state = self.settled(state)
        df, scope = state.df, dict(state.scope)
        new_nodes, new_rels = [], []
        for part in parts:
            names = [i.var or fresh(" new") for i in part.items]
            for n, item in zip(names[::2], part.items[::2], strict=True):
                if n in scope or any(n == x for x, _ in new_nodes):
                    if item.labels or item.props:
                        raise SemanticFault(f"{n!r} is already bound")
                    continue
                new_nodes.append((n, item))
            for i in range(1, len(part.items), 2):
                rel = part.items[i]
                if len(rel.types) != 1 or rel.variable or rel.direction == "both":
                    raise SemanticFault("CREATE needs one type and a direction for each relationship")
                a, b = (names[i - 1], names[i + 1]) if rel.direction == "out" else (names[i + 1], names[i - 1])
                new_rels.append((names[i], rel, a, b))
        made: dict[str, tuple[str, str, dict[str, tuple[str, T.DataType]]]] = {}
        env = Env(df, scope)
        cols = []
        for n, item in new_nodes:
            stem = fresh("new")
            labels = self.label_names(item.labels)
            props = {}
            cols.append(F.expr("uuid()").alias(f"{stem}_id"))
            for k, e in item.props:
                a = self.planner.arg(e, env)
                cols.append(a.col.cast("string" if isinstance(a.type, T.NullType) else a.type).alias(f"{stem}_{k}"))
                props[k] = (f"{stem}_{k}", a.type if not isinstance(a.type, T.NullType) else T.StringType())
            made[n] = ("&".join(labels), f"{stem}_id", props)
        for n, rel, a, b in new_rels:
            stem = fresh("new")
            props = {}
            cols.append(F.expr("uuid()").alias(f"{stem}_id"))
            for k, e in rel.props:
                x = self.planner.arg(e, env)
                cols.append(x.col.alias(f"{stem}_{k}"))
                props[k] = (f"{stem}_{k}", x.type)
            made[n] = (rel.types[0], f"{stem}_id", props)
        df = self.planner.graph.settle(df.select("*", *cols))
        ends: dict[str, list[tuple[str, str, Column | None]]] = {}
        for n, _ in new_nodes:
            label, ident, props = made[n]
            rows = df.select(col(ident).alias(ID), *(col(c).alias(k) for k, (c, _) in props.items()))
            self.append(f"n:{label}", rows)
            stem = fresh("n")
            df = df.select("*", F.lit(label).alias(f"{stem}_l"))
            mappings = tuple(m for m in self.planner.graph.nodes if m.table == f"n:{label}")
            scope[n] = Node(ident, f"{stem}_l", mappings, dict(props))
        for n, rel, a, b in new_rels:
            type_, ident, props = made[n]
            for la, ca in self.end_labels(scope[a]):
                for lb, cb in self.end_labels(scope[b]):
                    keep = F.lit(True) if ca is None else ca
                    keep = keep if cb is None else keep & cb
                    rows = df.where(keep).select(col(ident).alias(ID), col(scope[a].key).alias("_source"), col(scope[b].key).alias("_target"), *(col(c).alias(k) for k, (c, _) in props.items()))
                    self.append(f"e:{type_}:{la}:{lb}", rows)
            stem = fresh("r")
            df = df.select("*", F.lit(type_).alias(f"{stem}_t"))
            scope[n] = Rel(f"{stem}_t", ident, scope[a].key, scope[b].key, (type_,), dict(props))
        return State(df, scope, state.order, state.corr, state.outer)

    def label_names(self, tree: Any) -> list[str]:
        if tree is None:
            return [""]
        if tree[0] == "is":
            return [tree[1]]
        if tree[0] == "and" and all(t[0] == "is" for t in tree[1]):
            return sorted({t[1] for t in tree[1]})
        raise SemanticFault("CREATE needs plain labels")

    def end_labels(self, b: Node) -> list[tuple[str, Column | None]]:
        labels = sorted({m.tag for m in b.mappings})
        return [(labels[0], None)] if len(labels) == 1 else [(x, col(b.label) == x) for x in labels]

    def merge(self, m: A.Merge, state: State) -> State:
        """Rows that match keep their matches; distinct rows that do not are created once each."""
        state = self.settled(state)
        for item in m.part.items:
            for _, e in item.props:
                if isinstance(e, A.Lit) and e.value is None:
                    raise SemanticFault("MERGE cannot use null property values")
        p = self.planner
        row = fresh("row")
        state.df = p.graph.settle(state.df.withColumn(row, F.monotonically_increasing_id()))
        known = all(self.exists(i) for i in m.part.items)
        matched = p.graph.settle(p.pattern((m.part,), State(state.df, dict(state.scope))).df) if known else None
        missing = state.df if matched is None else state.df.join(matched.select(col(row)).distinct(), row, "left_anti")
        if matched is not None and not matched.isEmpty() and m.on_match:
            at = p.pattern((m.part,), State(state.df, dict(state.scope)))
            self.set(m.on_match, State(p.graph.settle(at.df), at.scope))
        if not missing.isEmpty():
            keys = []
            env = Env(missing, state.scope)
            for item in m.part.items:
                if item.var in state.scope and isinstance(state.scope[item.var], Node):
                    keys.append(col(state.scope[item.var].key))
                keys += [p.arg(e, env).col for _, e in item.props]
            named = [k.alias(f"_m{i}") for i, k in enumerate(keys)] or [F.lit(1).alias("_m0")]
            once = missing.select("*", *named).dropDuplicates([f"_m{i}" for i in range(len(named))]).select(*missing.columns)
            made = self.create((m.part,), State(once, dict(state.scope)))
            if m.on_create:
                self.set(m.on_create, made)
        return p.pattern((m.part,), State(state.df, dict(state.scope)))

    def exists(self, item: Any) -> bool:
        g = self.planner.graph
        if isinstance(item, A.NodePat):
            return bool(self.planner.candidates(item.labels)) or (item.var is not None and item.labels is None)
        return any(e.type in item.types for e in g.edges)

    def relabel(self, name: str, b: Node, change: set[str], remove: bool, state: State) -> State:
        """Move a node's row, and the ends of its relationships, to the tables of its new labels."""
        settle = self.planner.graph.settle
        touched = settle(state.df.select(col(b.key).alias(ID), col(b.label).alias("_was")).where(col(ID).isNotNull()).distinct())
        new_of = {}
        for m in b.mappings:
            labels = set(m.labels) - change if remove else set(m.labels) | change
            new_of[m.tag] = "&".join(sorted(labels))
        for tag, new in new_of.items():
            if tag == new:
                continue
            gone = touched.where(col("_was") == tag).select(ID)
            old = self.store.frame(f"n:{tag}")
            moved = settle(old.join(gone, ID, "left_semi"))
            self.put(f"n:{tag}", old.join(gone, ID, "left_anti"))
            self.append(f"n:{new}", moved)
            for edges in [n for n in self.store.names() if n.startswith("e:")]:
                _, type_, la, lb = edges.split(":")
                if tag not in (la, lb):
                    continue
                rows = self.store.frame(edges)
                at = lambda c, end: F.lit(None).cast("boolean") if end != tag else c.isNotNull()
                both = rows.join(gone.select(col(ID).alias("_source"), F.lit(1).alias("_a")), "_source", "left").join(gone.select(col(ID).alias("_target"), F.lit(1).alias("_b")), "_target", "left")
                both = settle(both.select(*rows.columns, F.coalesce(at(col("_a"), la), F.lit(False)).alias("_a"), F.coalesce(at(col("_b"), lb), F.lit(False)).alias("_b")))
                self.put(edges, both.where("NOT _a AND NOT _b").select(*rows.columns))
                for a, c in ((True, False), (False, True), (True, True)):
                    part = both.where((col("_a") == a) & (col("_b") == c)).select(*rows.columns)
                    if not part.isEmpty():
                        self.append(f"e:{type_}:{new if a else la}:{new if c else lb}", part)
        tags = F.lit(None)
        for tag, new in new_of.items():
            tags = F.when(col(b.label) == tag, F.lit(new)).otherwise(tags)
        stem = fresh("l")
        mappings = tuple(m for m in self.planner.graph.nodes if m.tag in set(new_of.values()))
        return State(state.df.select("*", tags.alias(stem)), state.scope | {name: Node(b.key, stem, mappings, b.props, b.held)}, state.order, state.corr, state.outer)

    def set(self, items: tuple[A.SetItem, ...], state: State, remove: bool = False) -> State:
        state = self.settled(state)
        for i in items:
            owner = i.target.owner if isinstance(i.target, A.Prop) else i.target
            b = state.scope.get(owner.name) if isinstance(owner, A.Var) else None
            if not isinstance(b, (Node, Rel)):
                raise SemanticFault("SET needs a node or relationship")
            if i.kind == "labels":
                if not isinstance(b, Node):
                    raise SemanticFault("only nodes have labels")
                state = self.relabel(owner.name, b, set(i.value), remove, state)
                continue
            env = Env(state.df, state.scope)
            if i.kind == "prop":
                a = self.planner.arg(i.value, env)
                changes = {i.target.key: a}
                keep = None
            else:
                a = self.planner.arg(i.value, env)
                if not isinstance(a.type, T.StructType):
                    raise SemanticFault("a map is needed")
                changes = {f.name: type(a)(a.col.getField(f.name), f.dataType) for f in a.type.fields}
                keep = None if i.kind == "merge" else set(changes)
            ident = b.key if isinstance(b, Node) else b.id
            new = state.df.select(col(ident).alias(ID), *(x.col.alias(f"_s_{k}") for k, x in changes.items())).where(col(ID).isNotNull()).dropDuplicates([ID])
            new = self.planner.graph.settle(new)
            prefix = "n:" if isinstance(b, Node) else "e:"
            names = [m.table for m in b.mappings] if isinstance(b, Node) else [n for n in self.store.names() if n.startswith("e:") and (not b.types or n.split(":")[1] in b.types)]
            for name in dict.fromkeys(n for n in names if n.startswith(prefix)):
                old = self.store.frame(name)
                joined = old.join(new.withColumn("_hit", F.lit(True)), ID, "left")
                cols = []
                for c in dict.fromkeys([*old.columns, *changes]):
                    before = col(c) if c in old.columns else F.lit(None)
                    if c in changes:
                        after = col(f"_s_{c}")
                        if c in old.columns:
                            after = after.cast(old.schema[c].dataType) if isinstance(changes[c].type, T.NullType) else after
                        elif isinstance(changes[c].type, T.NullType):
                            after = after.cast("string")
                        cols.append(F.when(col("_hit"), after).otherwise(before).alias(c))
                    elif keep is not None and not c.startswith("_"):
                        cols.append(F.when(col("_hit"), F.lit(None)).otherwise(before).alias(c))
                    else:
                        cols.append(before.alias(c))
                self.put(name, joined.select(*cols))
            # the row's own view of the entity follows
            state = self.view(state, owner.name, b, changes, keep)
        return state

    def view(self, state: State, name: str, b: Node | Rel, changes: dict, keep: set[str] | None) -> State:
        props = dict(b.props) if keep is None else {}
        cols = []
        for k, a in changes.items():
            c = fresh("set")
            t = T.StringType() if isinstance(a.type, T.NullType) else a.type
            cols.append(a.col.cast(t).alias(c))
            props[k] = (c, t)
        df = state.df.select("*", *cols)
        new = Node(b.key, b.label, b.mappings, props, b.held) if isinstance(b, Node) else Rel(b.type, b.id, b.source, b.target, b.types, props, b.ends)
        return State(df, state.scope | {name: new}, state.order, state.corr, state.outer)

    def delete(self, c: A.Delete, state: State) -> State:
        state = self.settled(state)
        nodes, rels = [], []
        for t in c.targets:
            b = state.scope.get(t.name) if isinstance(t, A.Var) else None
            if isinstance(b, Node):
                nodes.append(state.df.select(col(b.key).alias(ID)))
            elif isinstance(b, Rel):
                rels.append(state.df.select(col(b.id).alias(ID)))
            elif not isinstance(b, Value):
                raise SemanticFault("DELETE needs nodes or relationships")
        gone = lambda fs: self.planner.graph.settle(fs[0].unionByName(fs[1]) if len(fs) > 1 else fs[0]).where(col(ID).isNotNull()).distinct()
        if rels:
            dead = gone(rels)
            for name in [n for n in self.store.names() if n.startswith("e:")]:
                self.put(name, self.store.frame(name).join(dead, ID, "left_anti"))
        if nodes:
            dead = gone(nodes)
            for name in [n for n in self.store.names() if n.startswith("e:")]:
                edges = self.store.frame(name)
                left = edges.join(dead.withColumnRenamed(ID, "_source"), "_source", "left_anti").join(dead.withColumnRenamed(ID, "_target"), "_target", "left_anti")
                if c.detach:
                    self.put(name, left.select(*edges.columns))
                elif left.count() != edges.count():
                    raise ConstraintFault("a node still has relationships; use DETACH DELETE")
            for name in [n for n in self.store.names() if n.startswith("n:")]:
                self.put(name, self.store.frame(name).join(dead, ID, "left_anti"))
        return state
