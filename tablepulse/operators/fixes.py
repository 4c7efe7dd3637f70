"""Corrections as projections and filters: a fix maps a table to a corrected table.

A fix is a typed object, never free SQL text. ``apply`` gives the whole corrected table for a new
version, ``changed_rows`` the rows it would touch, ``dry_run`` the counts without changing anything.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepulse.functions import rates
from tablepulse.operators.joins import distinct_keys
from tablepulse.operators.measure import measure
from tablepulse.operators.rules import Rule, Tables, catalogue, tables_of, with_rule
from tablepulse.operators.scores import kpi_table, with_scores, with_status

# Risk levels, and the row count from which a fix is risky whatever it does.
LOW, MEDIUM, HIGH = "LOW", "MEDIUM", "HIGH"
MANY_ROWS = 20


@dataclass(frozen=True)
class Update:
    """``UPDATE table SET ... WHERE where``; every value reads the row as it was before."""

    name: str
    table: str
    where: str
    set: Mapping[str, str] = field(default_factory=dict)
    by_id: bool = False


@dataclass(frozen=True)
class Delete:
    """``DELETE FROM table WHERE where``; rows for which the condition is NULL stay."""

    name: str
    table: str
    where: str


@dataclass(frozen=True)
class DeleteOrphans:
    """Delete child rows without a parent row; a NULL key has no parent."""

    name: str
    table: str
    key: str
    parent: str
    parent_key: str
    parent_where: str = "true"


@dataclass(frozen=True)
class Remap:
    """Replace the listed values of a column, in all rows."""

    name: str
    table: str
    column: str
    mapping: Mapping[str, str] = field(default_factory=dict)


Fix = Update | Delete | DeleteOrphans | Remap


def _true(predicate: str) -> Column:
    return F.coalesce(F.expr(predicate), F.lit(False))


def _known_keys(tables: Tables, fix: DeleteOrphans) -> DataFrame:
    return distinct_keys(tables[fix.parent].where(fix.parent_where), fix.parent_key, "_known")


def _mapped(fix: Remap) -> Column:
    new = reduce(
        lambda chain, pair: chain.when(F.col(fix.column) == pair[0], F.lit(pair[1])),
        fix.mapping.items(),
        F.when(F.lit(False), F.col(fix.column)),
    )
    return new.otherwise(F.col(fix.column))


def apply(tables: Tables, fix: Fix) -> DataFrame:
    """The corrected table."""
    df = tables[fix.table]
    if isinstance(fix, Update):
        hit = _true(fix.where)
        types = {f.name: f.dataType for f in df.schema.fields}
        return df.withColumns(
            {c: F.when(hit, F.expr(v).cast(types[c])).otherwise(F.col(c)) for c, v in fix.set.items()}
        )
    if isinstance(fix, Delete):
        return df.where(~_true(fix.where))
    if isinstance(fix, DeleteOrphans):
        return df.join(_known_keys(tables, fix), F.expr(fix.key) == F.col("_known"), "left_semi")
    if isinstance(fix, Remap):
        return df.withColumn(fix.column, _mapped(fix))
    raise TypeError(f"unknown fix {type(fix).__name__}")


def changed_rows(tables: Tables, fix: Fix) -> DataFrame:
    """The rows a fix would change or delete, as they are now."""
    df = tables[fix.table]
    if isinstance(fix, (Update, Delete)):
        return df.where(_true(fix.where))
    if isinstance(fix, DeleteOrphans):
        return df.join(_known_keys(tables, fix), F.expr(fix.key) == F.col("_known"), "left_anti")
    if isinstance(fix, Remap):
        return df.where(F.col(fix.column).isin(*fix.mapping))
    raise TypeError(f"unknown fix {type(fix).__name__}")


def apply_all(tables: Tables, fixes: Iterable[Fix]) -> Tables:
    """All tables after the fixes, one after the other."""
    after = ChainMap({}, tables)
    for fix in fixes:
        after[fix.table] = apply(after, fix)
    return after


def _base_risk(fix: Fix) -> str:
    if isinstance(fix, (Delete, DeleteOrphans)):
        return HIGH
    return LOW if isinstance(fix, Update) and fix.by_id else MEDIUM


def risk_level(base: Column, n_rows: Column) -> Column:
    """High for deletes and for many rows; otherwise low for single rows by id, else medium."""
    return F.when(n_rows > MANY_ROWS, HIGH).otherwise(base)


def dry_run(tables: Tables, fixes: Iterable[Fix]) -> DataFrame:
    """``fix, table_name, action, affected_rows, risk_level`` — what would happen, without doing it.

    Conditions on one table are counted in one scan; orphan deletes need their anti-join.
    """
    fixes = list(fixes)
    by_table: dict[str, list[Fix]] = {}
    parts: list[DataFrame] = []
    for fix in fixes:
        if isinstance(fix, DeleteOrphans):
            counted = changed_rows(tables, fix).agg(F.count(F.lit(1)).alias("n_0"))
            parts.append(_report(counted, [fix]))
        else:
            by_table.setdefault(fix.table, []).append(fix)
    for table, group in by_table.items():
        hits = [
            F.col(f.column).isin(*f.mapping) if isinstance(f, Remap) else F.expr(f.where) for f in group
        ]
        counted = tables[table].agg(*(F.count_if(h).alias(f"n_{i}") for i, h in enumerate(hits)))
        parts.append(_report(counted, group))
    return reduce(DataFrame.unionAll, parts)


def _report(counted: DataFrame, fixes: list[Fix]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(f.name).alias("fix"),
            F.lit(f.table).alias("table_name"),
            F.lit("delete" if isinstance(f, (Delete, DeleteOrphans)) else "update").alias("action"),
            F.col(f"n_{i}").cast("long").alias("affected_rows"),
            risk_level(F.lit(_base_risk(f)), F.col(f"n_{i}")).alias("risk_level"),
        )
        for i, f in enumerate(fixes)
    ]
    return counted.select(F.inline(F.array(*rows)))


_COMPARED = ("num", "value", "score", "status")


def _renamed(kpis: DataFrame, *suffixes: str) -> DataFrame:
    full = with_status(with_scores(kpis))
    return full.select("kpi_id", *(F.col(c).alias(f"{c}_{s}") for s in suffixes for c in _COMPARED))


def _with_verdict(both: DataFrame) -> DataFrame:
    return both.withColumn("improved", F.col("score_after") > F.col("score_before"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two KPI tables side by side: counts, values, scores and status before and after."""
    return _with_verdict(_renamed(before, "before").join(_renamed(after, "after"), "kpi_id"))


def touched_rules(
    rules: Iterable[Rule], fixes: Iterable[Fix], views: Iterable[str] = ()
) -> tuple[list[Rule], list[Rule]]:
    """Rules that read a corrected table or one of the views, and the others."""
    changed = {fix.table for fix in fixes} | set(views)
    parts: tuple[list[Rule], list[Rule]] = ([], [])
    for rule in rules:
        parts[0 if tables_of(rule) & changed else 1].append(rule)
    return parts


# 0: as the tables are, 1: as they would be.
_SIDE = "_side"


def _on_both_sides(tables: Tables, fixes: Iterable[Fix]) -> Tables:
    """Every table with each row twice, as it is and as the fixes leave it, from one scan."""
    both = {name: df.withColumn(_SIDE, F.explode(F.array(F.lit(0), F.lit(1)))) for name, df in tables.items()}
    after = f"{_SIDE} = 1"
    for fix in fixes:
        df = both[fix.table]
        if isinstance(fix, (Update, Delete)):
            both[fix.table] = apply(both, replace(fix, where=f"{after} AND ({fix.where})"))
        elif isinstance(fix, Remap):
            both[fix.table] = df.withColumn(fix.column, F.when(F.expr(after), _mapped(fix)).otherwise(F.col(fix.column)))
        else:
            known = _known_keys({fix.parent: both[fix.parent].where(after)}, fix)
            joined = df.join(known, F.expr(fix.key) == F.col("_known"), "left")
            both[fix.table] = joined.where(f"NOT ({after}) OR _known IS NOT NULL").drop("_known")
    return both


def before_after(
    tables: Tables, rules: Iterable[Rule], fixes: Iterable[Fix], rebind=None, views: Iterable[str] = ()
) -> DataFrame:
    """What the KPIs are and what they would be after the fixes, from one measurement.

    Rules that read a corrected table, or one of the ``views`` over them, are counted for both sides in the same
    scans and shuffles; the others once. ``rebind(tables, by)`` rebuilds the views from base tables in which ``by``
    tells the sides apart.
    """
    rules, fixes = list(rules), list(fixes)
    touched, others = touched_rules(rules, fixes, views)
    parts = []
    if touched:
        base = {name: df for name, df in tables.items() if name not in set(views)} if rebind else dict(tables)
        both = _on_both_sides(base, fixes)
        counted = measure(rebind(both, _SIDE) if rebind else both, touched, by=_SIDE)
        per_side = [
            F.coalesce(F.max(F.when(F.col(_SIDE) == side, F.col(c))), F.lit(0)).cast("long").alias(f"{c}_{name}")
            for side, name in enumerate(("before", "after"))
            for c in ("num", "den")
        ]
        # Every rule has a row, even if its tables have none.
        zero = catalogue(counted.sparkSession, touched).select(
            F.lit(0).alias(_SIDE), "kpi_id", F.lit(0).cast("long").alias("num"), F.lit(0).cast("long").alias("den")
        )
        wide = counted.unionByName(zero).groupBy("kpi_id").agg(*per_side)
        rated = with_rule(wide, touched, "target_val", "higher_is_better")
        goal = (F.col("target_val"), F.col("higher_is_better"))
        columns = []
        for name in ("before", "after"):
            value = rates.pct(F.col(f"num_{name}"), F.col(f"den_{name}"))
            columns += [
                F.col(f"num_{name}"), value.alias(f"value_{name}"),
                rates.score(value, *goal).alias(f"score_{name}"), rates.rag(value, *goal).alias(f"status_{name}"),
            ]
        parts.append(_with_verdict(rated.select("kpi_id", *columns)))
    if others:
        parts.append(_with_verdict(_renamed(kpi_table(tables, others), "before", "after")))
    return reduce(DataFrame.unionByName, parts)
