"""The public interface: a graph over tables, queried by Cypher."""

from __future__ import annotations

import dataclasses
import re
import tempfile
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ArgumentFault, SemanticFault
from .functions import registry
from .operators import computed
from .plans import parser
from .plans.planner import Planner
from .policy import Policy
from .sources.mapping import ComputedMapping, EdgeMapping, Mapping, NodeMapping
from .sources.types import spark_type

Source = DataFrame | pa.Table | Callable[[], DataFrame] | str


class Graph:
    """A mapping over named tables.

    `tables` gives each table as a DataFrame, as SQL text or as a function that makes one; names not
    given are looked up in the session's catalog. `cypher` parses and plans; the result is lazy.
    """

    def __init__(self, spark: SparkSession, mapping: Mapping, tables: dict[str, Source] | None = None, policy: Policy | None = None, store: Any = None):
        self.spark, self.mapping, self.tables = spark, mapping.check(), dict(tables or {})
        self.policy, self.store = policy, store
        self.functions: dict[str, Callable[..., Column]] = {}
        self.aggregates: dict[str, Callable[..., Column]] = {}
        self.procedures: dict[str, Callable[..., DataFrame]] = {}
        self._frames: dict[str, DataFrame] = {}
        self._kinds: dict[str, str] = {}

    # --- what the planner asks ---

    @property
    def nodes(self) -> tuple[NodeMapping, ...]:
        return self.mapping.nodes

    @property
    def edges(self) -> tuple[EdgeMapping | ComputedMapping, ...]:
        return (*self.mapping.edges, *self.mapping.computed)

    def table(self, name: str) -> DataFrame:
        """A table as the policy lets it be seen: row filter first, then masks, before any predicate."""
        if name not in self._frames:
            got = self.tables.get(name)
            if got is None:
                df = self.spark.table(name)
            elif isinstance(got, str):
                df = self.spark.sql(got)
            elif isinstance(got, pa.Table):
                df = self.spark.createDataFrame(got)
            else:
                df = got if isinstance(got, DataFrame) else got()
            self._frames[name] = self.policy.secure(name, df) if self.policy is not None else df
        return self._frames[name]

    def _source(self, m: NodeMapping | EdgeMapping) -> DataFrame:
        df = self.query_source(m.query) if m.query else self.table(m.table)
        if m.collection:
            c = m.collection
            items = F.expr(c["expr"]) if "expr" in c else F.col(f"`{c['column']}`")
            ordinal = c.get("ordinality", "_ordinality")
            df = df.select("*", (F.posexplode_outer if c.get("outer") else F.posexplode)(items).alias(ordinal, c["as"]))
            df = df if "ordinality" in c else df.drop(ordinal)
        return df.where(m.where) if m.where else df

    def query_source(self, sql: str) -> DataFrame:
        return self.spark.sql(sql, **{n: self.table(n) for n in self.tables if "{" + n + "}" in sql})

    def rows(self, m: NodeMapping) -> DataFrame:
        return self._source(m)

    def key_kind(self, m: NodeMapping, planner: Planner) -> str:
        """The type of a table's keys, asked once."""
        if m.tag not in self._kinds:
            self._kinds[m.tag] = str(self.rows(m).select(planner._key(m.key, False).alias("k")).schema["k"].dataType)
        return self._kinds[m.tag]

    def edge_rows(self, e: EdgeMapping | ComputedMapping, planner: Planner) -> tuple[DataFrame, Column, Column, Column, dict[str, Column]]:
        """Rows of a relationship type with its ends, identity and properties."""
        if isinstance(e, ComputedMapping):
            df, props = computed.pairs(self, e)
            return df, F.col("_a"), F.col("_b"), F.concat_ws("|", F.col("_a").cast("string"), F.col("_b").cast("string")), props
        df = self._source(e)
        key = lambda names: planner._key(names, False)
        ident = e.id or (tuple(e.source_key) if planner._source_home(e) else tuple(e.target_key) if planner._home(e) else ())
        if ident:
            one = key(ident)
        else:  # no declared identity: all columns tell one relationship from another
            one = F.struct(*(F.col(f"`{c}`") for c in df.columns)).cast("string")
        return df, key(e.source_key), key(e.target_key), one, {p: F.col(f"`{c}`") for p, c in e.properties.items()}

    def procedure(self, name: str, args: list[Any]) -> DataFrame:
        low = name.lower()
        if low in self.procedures:
            return self.procedures[low](*args)
        lists = {
            "db.labels": ("label", sorted({x for n in self.nodes for x in n.labels})),
            "db.relationshiptypes": ("relationshipType", sorted({e.type for e in self.edges})),
            "db.propertykeys": ("propertyKey", sorted({p for m in (*self.nodes, *self.mapping.edges) for p in m.properties})),
        }
        if low == "db.functions":
            known = {**dict.fromkeys(registry.FUNCTIONS, "function"), **dict.fromkeys(registry.AGGREGATES, "aggregate")}
            known |= {**dict.fromkeys(self.functions, "function"), **dict.fromkeys(self.aggregates, "aggregate")}
            return self.spark.createDataFrame(sorted(known.items()), "name string, kind string")
        if low not in lists:
            raise SemanticFault(f"unknown procedure {name}")
        column, values = lists[low]
        return self.spark.createDataFrame([(v,) for v in values], f"{column} string")

    def settle(self, df: DataFrame) -> DataFrame:
        """Cut the lineage of a loop's step through the shared checkpoint folder."""
        sc = self.spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            where = sc.getConf().get("spark.checkpoint.dir", None)
            if where is None and sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="loomgraph-checkpoint-"))
        return df.checkpoint()

    def writer(self, planner: Planner) -> Any:
        if self.store is None:
            raise SemanticFault("this graph is read-only; open it through a store to write")
        return self.store.writer(planner)

    # --- use ---

    def cypher(self, text: str, **params: Any) -> DataFrame:
        """The result of a query as a lazy DataFrame; `EXPLAIN [COST | FORMATTED] query` gives its plan in one row."""
        asked = re.match(r"\s*EXPLAIN\s+(?:(COST|FORMATTED|EXTENDED)\s+)?", text, re.IGNORECASE)
        if asked:
            plan = self.explain(text[asked.end() :], (asked[1] or "formatted").lower(), **params)
            return self.spark.createDataFrame([(plan,)], "plan string")
        if self.policy is not None:
            self.policy.may_query(text)
        return Planner(self, params).run(parser.parse(text))

    def explain(self, text: str, mode: str = "extended", **params: Any) -> str:
        """The plan as text: extended, formatted, or cost (with the sizes and row counts Spark estimates)."""
        run = self.cypher(text, **params)._jdf.queryExecution()
        jvm = self.spark._jvm.org.apache.spark.sql.execution.ExplainMode
        return run.explainString(jvm.fromString(mode))

    def arrow(self, text: str, **params: Any) -> pa.Table:
        """The result of a query as an Arrow table on the driver: for results that fit there."""
        return self.cypher(text, **params).toArrow()

    def statistics(self, columns: bool = False) -> DataFrame:
        """Rows of every mapped table, and with `columns` the distinct and null values of each property.

        One aggregation a table, combined map-side; distinct values are estimated (HyperLogLog).
        """
        out = []
        for m in (*self.nodes, *self.mapping.edges):
            df, name = self._source(m), m.tag if isinstance(m, NodeMapping) else m.type
            props = m.properties if columns else {}
            aggs = [F.count(F.lit(1)).alias("n")]
            for p, c in props.items():
                aggs += [F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d_{p}"), F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"z_{p}")]
            one = df.agg(*aggs)
            rows = [F.struct(F.lit(None).cast("string").alias("property"), F.lit(None).cast("long").alias("distinct"), F.lit(None).cast("long").alias("nulls"))]
            rows += [F.struct(F.lit(p).alias("property"), F.col(f"d_{p}").alias("distinct"), F.col(f"z_{p}").alias("nulls")) for p in props]
            kind = "node" if isinstance(m, NodeMapping) else "relationship"
            one = one.select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(m.table).alias("table"), "n", F.explode(F.array(*rows)).alias("r"))
            out.append(one.select("kind", "name", "table", F.col("n").alias("rows"), "r.*"))
        df = out[0]
        for o in out[1:]:
            df = df.unionByName(o)
        return df

    def declare(self, name: str, fn: Callable[..., Column], params: list[str], returns: str, aggregate: bool = False) -> Graph:
        """A function with declared types: arguments are cast to `params`, the result to `returns`.

        The name of an aggregate begins with `agg.`; its function makes an aggregate column.
        """
        low = name.lower()
        if aggregate != low.startswith("agg."):
            raise SemanticFault("the name of an aggregate, and of nothing else, begins with agg.")
        kinds, result = [spark_type(p) for p in params], spark_type(returns)

        def build(*args: Any) -> Column:
            if len(args) != len(kinds):
                raise ArgumentFault(f"{name}() takes {len(kinds)} arguments")
            return fn(*(a.col.cast(t) for a, t in zip(args, kinds, strict=True))).cast(result)

        (self.aggregates if aggregate else self.functions)[low] = build
        return self

    def register(self, name: str, fn: Callable[..., Column]) -> Graph:
        """A scalar function of columns under a Cypher name."""
        self.functions[name.lower()] = lambda *args: fn(*(a.col for a in args))
        return self

    def register_procedure(self, name: str, fn: Callable[..., DataFrame]) -> Graph:
        """A table procedure: CALL name(args) YIELD columns."""
        self.procedures[name.lower()] = fn
        return self

    def extended(self, *more: ComputedMapping | EdgeMapping | NodeMapping) -> Graph:
        """A new graph with further mappings; this one is unchanged."""
        m = self.mapping
        nodes = (*m.nodes, *(x for x in more if isinstance(x, NodeMapping)))
        edges = (*m.edges, *(x for x in more if isinstance(x, EdgeMapping)))
        extra = (*m.computed, *(x for x in more if isinstance(x, ComputedMapping)))
        g = Graph(self.spark, dataclasses.replace(m, nodes=nodes, edges=edges, computed=extra), self.tables, self.policy, self.store)
        g.functions, g.procedures, g.aggregates = dict(self.functions), dict(self.procedures), dict(self.aggregates)
        return g
