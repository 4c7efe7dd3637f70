"""Root-cause records: one nested row per KPI that is off target, with sample rows as evidence."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablepulse.operators.drilldown import SAMPLE_LIMIT, failing_rows, first_rows, stringify, total_order
from tablepulse.operators.rules import Rule, RowRate, Tables, local_frame, with_rule
from tablepulse.operators.scores import with_status

DEFAULT_ACTION = "Review the failing rows and correct them at the source."


@dataclass(frozen=True)
class Cause:
    """What is known about why a KPI fails."""

    impact: str
    root_cause: str
    corrective_action: str
    preventive_action: str


_CAUSE_SCHEMA = pa.schema(
    [(c, pa.string()) for c in ("kpi_id", "impact", "root_cause", "corrective_action", "preventive_action")]
)


def evidence(tables: Tables, rules: Iterable[Rule], limit: int = SAMPLE_LIMIT) -> DataFrame:
    """``kpi_id, evidence array<json>``: the first failing rows of every rule that has a drill-down.

    Each rule is cut by its own top-k before anything is gathered, so at most ``limit`` rows per rule
    reach the arrays.
    """
    parts = []
    for rule in rules:
        if not rule.drillable:
            continue
        rows = first_rows(failing_rows(tables, rule), rule, limit)
        numbered = rows.withColumn(
            "_no", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*total_order(rows, rule.order)))
        )
        as_json = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
        text = stringify(numbered).select(F.lit(rule.kpi_id).alias("kpi_id"), "_no", as_json.alias("row"))
        parts.append(text)
    stacked = reduce(DataFrame.unionAll, parts)
    ordered = F.array_sort(F.collect_list(F.struct("_no", "row")))
    return stacked.groupBy("kpi_id").agg(F.transform(ordered, lambda r: r["row"]).alias("evidence"))


def dataset_of(rule: Rule) -> str:
    return rule.measure.table if isinstance(rule.measure, RowRate) else rule.measure.child


def rca_records(
    kpis: DataFrame,
    rules: Iterable[Rule],
    causes: Mapping[str, Cause],
    samples: DataFrame,
    detected_at: Column,
) -> DataFrame:
    """``kpi_id, affected_count, record`` for every KPI that is not green.

    ``record`` has the nested layout of ``schemas.RCA_RECORD``.
    """
    rules = list(rules)
    spark = kpis.sparkSession
    known = local_frame(spark, ({"kpi_id": k, **asdict(c)} for k, c in causes.items()), _CAUSE_SCHEMA)
    datasets = local_frame(
        spark,
        ({"kpi_id": r.kpi_id, "dataset": dataset_of(r)} for r in rules),
        pa.schema([("kpi_id", pa.string()), ("dataset", pa.string())]),
    )
    off_target = with_rule(with_status(kpis).where("status <> 'GREEN'"), rules, "name", "owner")
    affected = F.when(F.col("higher_is_better"), F.col("den") - F.col("num")).otherwise(F.col("num"))
    rows = (
        off_target.withColumn("affected_count", affected)
        .join(F.broadcast(datasets), "kpi_id", "left")
        .join(F.broadcast(known), "kpi_id", "left")
        .join(samples, "kpi_id", "left")
    )
    violated = F.format_string("%s: %s is %.1f%%, target %.1f%%", "kpi_id", "name", "value", "target_val")
    summary = F.format_string("%s rows=%d, rate %.1f%%", "name", "affected_count", "value")
    unknown = F.format_string("KPI %s has %d failing rows to look into.", "kpi_id", "affected_count")
    record = F.struct(
        summary.alias("issueSummary"),
        F.struct(
            detected_at.cast("string").alias("timestamp"),
            F.col("dataset"),
            violated.alias("ruleViolated"),
            F.col("status").alias("severity"),
        ).alias("detectionDetails"),
        F.coalesce("impact", F.lit("")).alias("impact"),
        F.coalesce("root_cause", unknown).alias("rootCause"),
        F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"),
        F.coalesce("corrective_action", F.lit(DEFAULT_ACTION)).alias("correctiveAction"),
        F.coalesce("preventive_action", F.lit("")).alias("preventiveAction"),
        F.col("owner"),
        F.lit("Open").alias("status"),
    )
    return rows.select("kpi_id", "affected_count", record.alias("record"))
