"""The rows behind a KPI.

Each rule kind has one meaning of "failing row"; a row rate shows the rows of its numerator. Results
are totally ordered before they are cut, so the same rows come back on every run, and the cut is a
per-task top-k followed by a merge.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablepulse.operators.joins import distinct_keys
from tablepulse.operators.measure import off_by_more, reconcile_groups
from tablepulse.operators.rules import (
    AmbiguousRate,
    MatchRate,
    OrphanRate,
    ReconcileRate,
    ResolveRate,
    RowRate,
    Rule,
    Tables,
    find_rule,
)

DRILL_LIMIT = 50
SAMPLE_LIMIT = 20
_KEY = "_rule_key"


def failing_rows(tables: Tables, rule: Rule) -> DataFrame:
    """All rows behind the KPI, uncut, with the columns the rule shows.

    ``show`` may compute from any column of the table whose rows are listed. Grouped rules list groups:
    an ambiguous rate offers ``n_values, sample_value`` and plain parent columns, a reconciliation
    ``key, amount, total, discrepancy`` and plain parent columns, which then join the group key.
    """
    m = rule.measure
    if not rule.drillable or isinstance(m, ResolveRate):
        raise KeyError(f"KPI '{rule.kpi_id}' has no drill-down")
    if isinstance(m, RowRate):
        return tables[m.table].where(F.expr(m.hit)).selectExpr(*rule.show)
    parent, child = tables[m.parent], tables[m.child]
    if isinstance(m, MatchRate):
        linked = distinct_keys(child.where(m.child_where), m.child_key, _KEY)
        return parent.join(linked, F.expr(m.parent_key) == F.col(_KEY), "left_anti").selectExpr(*rule.show)
    if isinstance(m, OrphanRate):
        known = distinct_keys(parent.where(m.parent_where), m.parent_key, _KEY)
        return child.join(known, F.expr(m.child_key) == F.col(_KEY), "left_anti").selectExpr(*rule.show)
    if isinstance(m, AmbiguousRate):
        return _ambiguous_keys(parent, child, rule).selectExpr(*rule.show)
    if isinstance(m, ReconcileRate):
        also = _columns_beyond(rule.show, {"key", "amount", "total", "discrepancy"})
        groups = reconcile_groups(parent, child, m, *also)
        failing = groups.where(off_by_more("total", "amount", m.tolerance))
        return failing.withColumn("discrepancy", F.abs(F.col("total") - F.col("amount"))).selectExpr(*rule.show)
    raise TypeError(f"unknown measure {type(m).__name__}")


def _columns_beyond(show: Iterable[str], known: set[str]) -> list[str]:
    """Plain column names among the shown expressions that are not computed here."""
    return [e for e in show if e.isidentifier() and e not in known]


def _ambiguous_keys(parent: DataFrame, child: DataFrame, rule: Rule) -> DataFrame:
    """Shown parent columns with ``n_values, sample_value`` of the active child rows.

    Spark first removes repeated (key, value) pairs, spread over both, and only then counts per key,
    so a key with very many child rows is not gathered in one task. Equal parent rows become one
    after the join has left only the few that fail.
    """
    m: AmbiguousRate = rule.measure
    counted = (
        child.where(m.child_where)
        .groupBy(F.expr(m.child_key).alias(_KEY))
        .agg(
            F.count_distinct(F.expr(m.child_value)).alias("n_values"),
            F.min(F.expr(m.child_value)).alias("sample_value"),
        )
        .where("n_values > 1")
    )
    shown = _columns_beyond(rule.show, {"n_values", "sample_value"})
    parents = parent.select(F.expr(m.parent_key).alias(_KEY), *shown)
    return parents.join(counted, _KEY).distinct()


def stringify(df: DataFrame) -> DataFrame:
    """Dates, timestamps and decimals as text; numbers, booleans and text stay as they are."""
    as_text = (T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)
    return df.select(
        *(
            F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, as_text) else F.col(f.name)
            for f in df.schema.fields
        )
    )


def drilldown(tables: Tables, rules: Iterable[Rule], kpi_id: str, limit: int = DRILL_LIMIT) -> DataFrame:
    """Up to ``limit`` failing rows of a KPI; the id is not case-sensitive, an unknown id is an error."""
    rule = find_rule(rules, kpi_id)
    return stringify(first_rows(failing_rows(tables, rule), rule, limit))


def first_rows(failing: DataFrame, rule: Rule, limit: int) -> DataFrame:
    """Cut in the rule's order."""
    return failing.orderBy(*total_order(failing, rule.order)).limit(limit)


def total_order(df: DataFrame, leading: Iterable[str] = ()) -> list[Column]:
    """Leading columns (``"c"`` ascending, ``"-c"`` descending), then every column; NULLs come last."""
    return [
        F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_last(c) for c in (*leading, *df.columns)
    ]


def failing_sample(failing: DataFrame, order: Iterable[str], limit: int = SAMPLE_LIMIT) -> DataFrame:
    """Up to ``limit`` rows per KPI of a long table of failing rows, with the uncut total and a note.

    ``failing`` has ``kpi_id`` and any other columns. The rank filter is applied in every task before
    the shuffle, so a KPI with a third of all rows sends at most ``limit`` rows per task; the totals
    are counted by a separate map-side combined aggregate.
    """
    ranked = failing.withColumn(
        "sample_no", F.row_number().over(Window.partitionBy("kpi_id").orderBy(*total_order(failing, order)))
    ).where(F.col("sample_no") <= limit)
    totals = failing.groupBy("kpi_id").agg(F.count(F.lit(1)).alias("total_failing"))
    extra = F.col("total_failing") - limit
    note = F.when(extra > 0, F.format_string("...and %d more rows", extra)).otherwise("")
    return ranked.join(totals, "kpi_id").withColumn("note", note)
