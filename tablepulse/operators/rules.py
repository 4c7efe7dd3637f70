"""Declarative KPI rules: what is counted, over which tables, and against which target.

Predicates and values are SQL expressions over the columns of the named table. A predicate that is
NULL for a row does not count that row, as in a WHERE clause.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class RowRate:
    """Rows of ``table`` that satisfy ``hit``, per row that satisfies ``among`` (default: every row).

    The numerator is not restricted to ``among``; a rule that wants this says so in ``hit``.
    """

    table: str
    hit: str
    among: str = "true"


@dataclass(frozen=True)
class KeyedRate:
    """Base of the rules that relate a parent and a child table by a key.

    ``parent_where`` decides which parent rows exist for the rule, ``child_where`` which child rows
    are active. NULL keys never match.
    """

    parent: str
    child: str
    parent_key: str
    child_key: str
    parent_where: str = "true"
    child_where: str = "true"

    @property
    def pair(self) -> tuple[str, str, str, str]:
        return (self.parent, self.child, self.parent_key, self.child_key)


@dataclass(frozen=True)
class MatchRate(KeyedRate):
    """Distinct parent keys with an active child row, per parent row."""


@dataclass(frozen=True)
class OrphanRate(KeyedRate):
    """Child rows whose key has no parent row, per child row. A NULL key is an orphan."""


@dataclass(frozen=True)
class ResolveRate(KeyedRate):
    """Matching (parent, child) row pairs, per child row; repeated parents push it above 100 %."""


@dataclass(frozen=True)
class AmbiguousRate(KeyedRate):
    """Keys whose active child rows carry more than one distinct ``child_value``, per parent row.

    The keys come from the child table alone: orphan keys and the NULL key count too.
    """

    child_value: str = ""


@dataclass(frozen=True)
class ReconcileRate(KeyedRate):
    """(key, amount) groups of the parent whose active child amounts sum up to something else.

    A group fails when the sum is off by more than ``tolerance`` times the parent amount. Every copy
    of a parent row repeats its child rows in the sum; keys without active child rows are not tested.
    """

    parent_amount: str = ""
    child_amount: str = ""
    tolerance: float = 0.05


@dataclass(frozen=True)
class Rule:
    kpi_id: str
    name: str
    pillar: str
    owner: str
    target: float
    higher_is_better: bool
    measure: RowRate | KeyedRate
    component: str = "rate"  # what the pillar averages: clean share ("rate") or score ("score")
    scored: bool = True  # False: reported, but in neither the pillar nor the overall score
    entities: tuple[str, ...] = ()
    show: tuple[str, ...] = ()  # drill-down columns, as SQL expressions; see drilldown.failing_rows
    order: tuple[str, ...] = ()  # leading drill-down sort columns, "-c" for descending
    drillable: bool = True


@dataclass(frozen=True)
class Entity:
    """Share of clean rows of one table.

    ``total_of`` is the KPI whose denominator counts the table; ``bad`` adds the numerators of KPIs,
    ``missing`` adds their denominators minus numerators.
    """

    name: str
    total_of: str
    bad: tuple[str, ...] = ()
    missing: tuple[str, ...] = ()


def local_frame(spark: SparkSession, rows: Iterable[Mapping[str, Any]], schema: pa.Schema) -> DataFrame:
    """A small driver-side table (catalogues, literal batches) as an in-plan local relation."""
    return spark.createDataFrame(pa.Table.from_pylist(list(rows), schema=schema))


CATALOGUE_SCHEMA = pa.schema(
    [
        ("kpi_id", pa.string()),
        ("ordinal", pa.int32()),
        ("name", pa.string()),
        ("pillar", pa.string()),
        ("owner", pa.string()),
        ("target_val", pa.float64()),
        ("higher_is_better", pa.bool_()),
        ("component", pa.string()),
        ("scored", pa.bool_()),
        ("entities", pa.list_(pa.string())),
    ]
)


def catalogue(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """One row per rule, in catalogue order."""
    return local_frame(
        spark,
        (
            {
                "kpi_id": r.kpi_id,
                "ordinal": i,
                "name": r.name,
                "pillar": r.pillar,
                "owner": r.owner,
                "target_val": float(r.target),
                "higher_is_better": r.higher_is_better,
                "component": r.component,
                "scored": r.scored,
                "entities": list(r.entities),
            }
            for i, r in enumerate(rules, 1)
        ),
        CATALOGUE_SCHEMA,
    )


def rules_of_entity(rule_table: DataFrame, entity: str) -> DataFrame:
    return rule_table.where(F.array_contains("entities", entity))


def with_rule(df: DataFrame, rules: Iterable[Rule], *columns: str) -> DataFrame:
    """Left lookup of catalogue columns by ``kpi_id``; the catalogue is a fixed, small list."""
    dim = catalogue(df.sparkSession, rules).select("kpi_id", *columns)
    return df.join(F.broadcast(dim), "kpi_id", "left")


def tables_of(rule: Rule) -> set[str]:
    """The tables and views a rule reads."""
    m = rule.measure
    return {m.table} if isinstance(m, RowRate) else {m.parent, m.child}


def find_rule(rules: Iterable[Rule], kpi_id: str) -> Rule:
    wanted = kpi_id.upper()
    for rule in rules:
        if rule.kpi_id == wanted:
            return rule
    raise KeyError(f"no rule for KPI '{kpi_id}'")
