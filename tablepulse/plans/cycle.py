"""The life of an issue: detect, explain, fix, verify. Pure functions; the caller writes the results."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepulse.operators import alerts, fixes, history, rootcause, scores
from tablepulse.operators.alerts import AlertText
from tablepulse.operators.rootcause import Cause
from tablepulse.operators.rules import Rule, Tables, find_rule

POST_FIX = "Post-fix"


def detect(
    tables: Tables, rules: Iterable[Rule], texts: Mapping[str, AlertText], known: DataFrame, at: Column, highest: int | None = None
) -> DataFrame:
    """New alert rows for every KPI that is off target and not being worked on.

    ``highest`` is the last number given, where the table keeps it.
    """
    rules = list(rules)
    found = alerts.candidates(scores.kpi_table(tables, rules), rules, texts)
    return alerts.raised(alerts.not_yet_raised(found, known), known if highest is None else highest, at)


def explain(
    tables: Tables, rules: Iterable[Rule], causes: Mapping[str, Cause], known: DataFrame, kpi_id: str, at: Column
) -> DataFrame:
    """The alert table with the root cause of one KPI written to its pending alerts, now under review."""
    joined, pending = _with_cause(tables, rules, causes, known, kpi_id, at)
    return alerts.in_review(joined, pending, F.col("_text")).drop("_kpi", "_text")


def explained(
    tables: Tables, rules: Iterable[Rule], causes: Mapping[str, Cause], known: DataFrame, kpi_id: str, at: Column
) -> DataFrame:
    """The rows that ``explain`` changes, alone."""
    joined, pending = _with_cause(tables, rules, causes, known, kpi_id, at)
    return alerts.in_review(joined.where(pending), F.lit(True), F.col("_text")).drop("_kpi", "_text")


def _with_cause(tables: Tables, rules: Iterable[Rule], causes: Mapping[str, Cause], known: DataFrame, kpi_id: str, at: Column):
    """Alerts beside the text of the root cause, and which of them are pending."""
    rule = find_rule(rules, kpi_id)
    samples = rootcause.evidence(tables, [rule])
    records = rootcause.rca_records(scores.kpi_table(tables, [rule]), [rule], causes, samples, at)
    texts = records.select(
        F.col("kpi_id").alias("_kpi"),
        F.concat(
            F.lit("ROOT CAUSE: "), F.col("record.rootCause"),
            F.lit("\n\nEVIDENCE: "), F.array_join("record.evidence", "; "),
            F.lit("\n\nACTION: "), F.col("record.correctiveAction"),
        ).alias("_text"),
    )
    joined = known.join(F.broadcast(texts), F.col("kpi_id") == F.col("_kpi"), "left")
    return joined, F.col("_text").isNotNull() & (F.col("status") != alerts.RESOLVED)


@dataclass(frozen=True)
class Outcome:
    """What a fix did, or would do: corrected tables, alert table, new capture, KPIs side by side."""

    plan: DataFrame
    tables: Tables
    alerts: DataFrame
    capture: DataFrame | None = None
    compared: DataFrame | None = None


def remediate(
    tables: Tables,
    rules: Iterable[Rule],
    fix: fixes.Fix,
    known: DataFrame,
    alert_id: int,
    explanation: str,
    at: Column,
    approved: bool = False,
) -> Outcome:
    """Without approval only the plan. With it: the fix, the closed alert, a new capture, the comparison.

    The KPIs are measured once before the fix; after it, only those that read the corrected table are.
    """
    rules = list(rules)
    plan = fixes.dry_run(tables, [fix])
    if not approved:
        return Outcome(plan, tables, known)
    fixed = fixes.apply_all(tables, [fix])
    touched, others = fixes.touched_rules(rules, [fix])
    before = scores.pinned(scores.kpi_table(tables, rules))
    after = before.where(F.col("kpi_id").isin([r.kpi_id for r in others]))
    if touched:
        after = after.unionAll(scores.pinned(scores.kpi_table(fixed, touched)))
    resolved = alerts.resolved(known, F.col("alert_id") == alert_id, _log(fix, explanation, at), at)
    return Outcome(plan, fixed, resolved, history.capture(after, rules, POST_FIX, at), fixes.compare(before, after))


def _log(fix: fixes.Fix, explanation: str, at: Column) -> Column:
    return F.concat_ws(" | ", at.cast("string"), F.lit(f"{fix.name} on {fix.table}"), F.lit(explanation))


def closed(known: DataFrame, fix: fixes.Fix, alert_id: int, explanation: str, at: Column) -> DataFrame:
    """The alert that a fix closes, alone."""
    return alerts.resolved(known.where(F.col("alert_id") == alert_id), F.lit(True), _log(fix, explanation, at), at)
