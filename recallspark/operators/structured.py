"""Structured branch: filters as predicates that reach the scan, explicit and intent rankings."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import resolve_predicate, value_identity


@dataclass(frozen=True)
class Filters:
    """Equality on the fields that are set; history only on demand. None: not set."""

    memory_type: str | None = None
    predicate: str | None = None
    subject_type: str | None = None
    fact_key: str | None = None
    conversation_id: object = None
    include_history: bool | None = None

    @property
    def selective(self) -> bool:
        return any(x is not None for x in (self.memory_type, self.predicate, self.subject_type, self.fact_key, self.conversation_id))


def condition(filters: Filters, include_history: bool | None = None) -> Column:
    """The conjunction all branches share. Names are compared as they are; aliases are not resolved."""
    history = filters.include_history if include_history is None else include_history
    parts = [] if history else [F.col("is_active")]
    parts += [F.col(n) == F.lit(v) for n in ("memory_type", "predicate", "subject_type", "fact_key", "conversation_id") if (v := getattr(filters, n)) is not None]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _ranked(rows: DataFrame, limit: int, by: tuple[str, ...]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col("is_active").desc(), F.col("updated_at").desc(), F.col("created_at").desc(), F.col("id").desc())
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit)


def explicit(memories: DataFrame, filters: Filters, limit: int, by: tuple[str, ...] = ("scope",)) -> DataFrame:
    """The first limit memories of each scope that pass; none unless some field besides history is set."""
    return _ranked(memories.filter(condition(filters)) if filters.selective else memories.filter(F.lit(False)), limit, by)


def by_intent(memories: DataFrame, intents: DataFrame, filters: Filters, limit: int) -> DataFrame:
    """memories ranked for each of intents(scope, qid, predicate, value, temporal_scope).

    Unknown predicates give nothing. current, or history refused by the caller: active rows; historical: inactive ones; any: both.
    History refused and historical asked for: nothing. Values are compared by identity after ordering, before the limit.
    """
    refused = filters.include_history is False
    asked = intents.withColumn("known", resolve_predicate(F.col("predicate"))).filter(F.col("known").isNotNull()).withColumnsRenamed({"predicate": "asked_predicate", "value": "asked_value"})
    if refused:
        asked = asked.filter("temporal_scope <> 'historical'")
    rows = memories.filter(condition(filters, include_history=True)).join(asked, "scope").filter(F.col("predicate") == F.col("known"))
    wanted = F.lit(True) if refused else (F.col("temporal_scope") == "any")
    if refused:
        rows = rows.filter("is_active")
    else:
        rows = rows.filter(wanted | ((F.col("temporal_scope") == "current") & F.col("is_active")) | ((F.col("temporal_scope") == "historical") & ~F.col("is_active")))
    rows = rows.filter(F.col("asked_value").isNull() | value_identity(F.col("value")).eqNullSafe(value_identity(F.col("asked_value"))))
    return _ranked(rows, limit, ("scope", "qid"))
