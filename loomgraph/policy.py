"""Row filters, column masks and permission scopes, applied before any user predicate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import PolicyFault


@dataclass
class Policy:
    """Decisions about one identity.

    `decide(action, resource)` answers True, False or, for row filters and masks, SQL text; any
    error or malformed answer denies. Filters see raw rows and are joined by AND, masks come after.
    """

    decide: Callable[[str, dict[str, Any]], Any]
    permissions: DataFrame | None = None
    scopes: dict[str, dict[str, str]] = field(default_factory=dict)
    subject: tuple[str, str] = ("user", "")

    def ask(self, action: str, resource: dict[str, Any]) -> Any:
        try:
            return self.decide(action, resource)
        except Exception as e:  # a policy that fails denies
            raise PolicyFault(f"{action} could not be decided") from e

    def may_query(self, text: str) -> None:
        if self.ask("ExecuteQuery", {"query": text}) is not True:
            raise PolicyFault("the query is denied")

    def secure(self, table: str, df: DataFrame) -> DataFrame:
        if self.ask("SelectFromColumns", {"table": table, "columns": df.columns}) is not True:
            raise PolicyFault(f"reading {table} is denied")
        filters = self.ask("GetRowFilters", {"table": table})
        masks = self.ask("GetColumnMasks", {"table": table, "columns": df.columns})
        if not isinstance(filters, (list, type(None))) or not isinstance(masks, (dict, type(None))):
            raise PolicyFault(f"malformed decision for {table}")
        for f in filters or []:
            df = df.where(F.expr(f))
        df = self.scoped(table, df)
        if masks:
            df = df.select(*(F.expr(masks[c]).alias(c) if c in masks else F.col(f"`{c}`") for c in df.columns))
        return df

    def scoped(self, table: str, df: DataFrame) -> DataFrame:
        """Keep rows whose key the permission relation grants to the subject."""
        scope = self.scopes.get(table)
        if scope is None:
            return df
        if self.permissions is None:
            raise PolicyFault(f"{table} is scoped but there is no permission relation")
        p = self.permissions
        granted = p.where(
            (p.resource_type == scope["resource_type"]) & (p.resource_rel == scope["relation"])
            & (p.subject_type == self.subject[0]) & (p.subject_id == self.subject[1])
        ).select(F.col("resource_id").alias("_granted"))
        return df.join(granted, F.col(f"`{scope['column']}`").cast("string") == F.col("_granted"), "left_semi")
