"""Alerts: raise, de-duplicate, list, change status.

A status change is a projection over the alert table; the caller writes the result as a new version.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepulse.operators.history import with_next_ids
from tablepulse.operators.rules import Rule, local_frame, with_rule
from tablepulse.operators.scores import with_status
from tablepulse.sources.schemas import DQ_ALERTS

# The life cycle of an alert.
OPEN = "Open"
IN_REVIEW = "In Review"
RESOLVED = "Resolved"


DEFAULT_ADVICE = "Look at the failing rows in the drill-down."


@dataclass(frozen=True)
class AlertText:
    """What is wrong and what to do about it, in words, for one KPI."""

    meaning: str
    advice: str


_TEXT_SCHEMA = pa.schema([("kpi_id", pa.string()), ("meaning", pa.string()), ("advice", pa.string())])


def candidates(kpis: DataFrame, rules: Iterable[Rule], texts: Mapping[str, AlertText]) -> DataFrame:
    """One alert per KPI that is not green, addressed to its owner.

    Severity is always the computed status; KPIs without a text of their own get a general one.
    """
    rules = list(rules)
    words = local_frame(
        kpis.sparkSession,
        ({"kpi_id": k, "meaning": t.meaning, "advice": t.advice} for k, t in texts.items()),
        _TEXT_SCHEMA,
    )
    off_target = with_rule(with_status(kpis).where("status <> 'GREEN'"), rules, "ordinal", "name", "owner", "scored")
    worded = off_target.where("scored").join(F.broadcast(words), "kpi_id", "left")
    fact = F.format_string(
        "For the %s: %s is %.1f%% (%d of %d), target %.1f%%.",
        "owner", "name", "value", "num", "den", "target_val",
    )
    return worded.select(
        "kpi_id",
        "ordinal",
        "owner",
        F.col("value").alias("kpi_value"),
        F.col("target_val").alias("target_value"),
        F.col("status").alias("severity"),
        F.concat_ws(" ", fact, "meaning").alias("message"),
        F.coalesce("advice", F.lit(DEFAULT_ADVICE)).alias("recommendation"),
    )


def not_yet_raised(batch: DataFrame, alerts: DataFrame, only_open: bool = False) -> DataFrame:
    """Candidates without an alert that is still being worked on.

    With ``only_open`` just alerts in status Open count, so a KPI under review is raised again.
    """
    pending = F.col("status") == OPEN if only_open else F.col("status") != RESOLVED
    return batch.join(alerts.where(pending).select("kpi_id").distinct(), "kpi_id", "left_anti")


def raised(batch: DataFrame, alerts: DataFrame | int, created_at: Column) -> DataFrame:
    """The batch as full alert rows: new ids after those of ``alerts`` or after a number, status Open."""
    numbered = with_next_ids(batch, alerts, "alert_id", ["ordinal"])
    filled = numbered.withColumns(
        {
            "created_at": created_at,
            "status": F.lit(OPEN),
            "remediation_log": F.lit(None).cast("string"),
            "resolved_at": F.lit(None).cast("timestamp"),
        }
    )
    return filled.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in DQ_ALERTS.fields))


def pending_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts that are not resolved, red before amber before others, newest first."""
    rank = F.when(F.col("severity") == "RED", 1).when(F.col("severity") == "AMBER", 2).otherwise(3)
    return (
        alerts.where(F.col("status") != RESOLVED)
        .withColumn("severity_rank", rank)
        .orderBy("severity_rank", F.desc("created_at"), "alert_id")
    )


def in_review(alerts: DataFrame, which: Column, message: Column) -> DataFrame:
    """Attach a root cause to the alerts in ``which``."""
    hit = F.coalesce(which, F.lit(False))
    return alerts.withColumns(
        {
            "message": F.when(hit, message).otherwise(F.col("message")),
            "status": F.when(hit, IN_REVIEW).otherwise(F.col("status")),
        }
    )


def resolved(alerts: DataFrame, which: Column, log: Column, resolved_at: Column) -> DataFrame:
    """Close the alerts in ``which`` with what was done and when."""
    hit = F.coalesce(which, F.lit(False))
    return alerts.withColumns(
        {
            "status": F.when(hit, RESOLVED).otherwise(F.col("status")),
            "remediation_log": F.when(hit, log).otherwise(F.col("remediation_log")),
            "resolved_at": F.when(hit, resolved_at).otherwise(F.col("resolved_at")),
        }
    )


def recent_fixes(alerts: DataFrame, limit: int = 5) -> DataFrame:
    """The last applied fixes."""
    return (
        alerts.where(F.col("remediation_log").isNotNull())
        .select("alert_id", "resolved_at", "kpi_id", "remediation_log")
        .orderBy(F.desc("resolved_at"), "alert_id")
        .limit(limit)
    )


def cleared(alerts: DataFrame) -> DataFrame:
    """Delete every alert that has an id."""
    return alerts.where(F.col("alert_id").isNull())
