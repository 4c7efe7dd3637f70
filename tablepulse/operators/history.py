"""KPI history: capture, list, deltas, trend.

A capture is one wide row; the long form ``captured_at, kpi_id, value`` is what windows run on, so
that every KPI has a partition of its own. History grows with the number of captures, not with the
measured data.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablepulse.functions import rates
from tablepulse.operators.joins import distinct_keys
from tablepulse.operators.rules import RowRate, Rule, with_rule
from tablepulse.operators.scores import overall_mean, pillar_mean, with_parts
from tablepulse.sources.schemas import KPI_COLUMNS, KPI_SNAPSHOTS, PILLAR_COLUMNS, SCORE_COLUMNS

MAX_BATCH = 10_000


def capture(kpis: DataFrame, rules: Iterable[Rule], label: str | None, captured_at: Column) -> DataFrame:
    """The wide snapshot row of a KPI table; KPIs that were not measured are NULL."""
    overall = overall_mean().alias("overall_score")
    pillars = [pillar_mean(pillar).alias(column) for pillar, column in PILLAR_COLUMNS.items()]
    # The pivot over a fixed list of KPIs; with the roll-ups it is one aggregate over one KPI table.
    values = [F.max(F.when(F.col("kpi_id") == c.upper(), F.col("value"))).alias(c) for c in KPI_COLUMNS]
    wide = with_parts(kpis, rules).agg(overall, *pillars, *values)
    return wide.select(captured_at.alias("captured_at"), F.lit(label).cast("string").alias("label"), "*")


def _highest(existing: DataFrame | int, id_column: str) -> Column:
    """The highest id given so far: a number that a ledger's commit holds, or the table's present maximum."""
    if isinstance(existing, int):
        return F.lit(existing).cast("long")
    return existing.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("long")).scalar()


def with_next_ids(batch: DataFrame, existing: DataFrame | int, id_column: str, order: Iterable[str]) -> DataFrame:
    """Number a small batch from the highest existing id upwards; more than ``MAX_BATCH`` rows are an error.

    Such a batch is one row per rule or the like and is numbered by one task; ``numbered_by`` takes any size.
    """
    highest = _highest(existing, id_column)
    position = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    checked = F.when(position <= MAX_BATCH, position).otherwise(F.raise_error(F.lit("too many rows to be numbered as a batch")))
    return batch.withColumn(id_column, highest + checked)


def numbered_by(batch: DataFrame, existing: DataFrame | int, id_column: str, group: Column, order: Iterable[str]) -> DataFrame:
    """Number a batch of any size from the highest existing id upwards.

    ``group`` does not decrease along the order (a day, say). Every group numbers its own rows, and the number of rows
    in the groups before it is added, so only the counts of the groups meet in one task.
    """
    highest = _highest(existing, id_column)
    grouped = batch.withColumn("_group", group)
    counts = grouped.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_group").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("_group").orderBy(*order))
    placed = grouped.withColumn("_own", own).join(offsets, F.col("_group").eqNullSafe(F.col("_of")))
    return placed.withColumn(id_column, highest + F.col("_offset") + F.col("_own")).drop("_group", "_of", "_own", "_offset")


def not_yet_captured(batch: DataFrame, history: DataFrame, bounded: bool = False) -> DataFrame:
    """Rows of ``batch`` whose ``captured_at``, to the second, is not in the history.

    With ``bounded``, meant for a batch that is small beside the history, only the history between the batch's first and
    last second is read: both are found in one pass over the batch while the query runs and reach the scan, which skips
    partitions by a ``captured_on`` date, if the history is partitioned by one, and row groups by ``captured_at``.
    """
    second = "date_trunc('second', captured_at)"
    if bounded:
        first, end = (batch.agg(f(F.expr(second)).alias("at")).scalar() for f in (F.min, F.max))
        history = history.where((F.col("captured_at") >= first) & (F.col("captured_at") < end + F.expr("INTERVAL 1 SECOND")))
        if "captured_on" in history.columns:
            history = history.where(F.col("captured_on").between(F.to_date(first), F.to_date(end)))
    seen = distinct_keys(history, second, "_second")
    return batch.join(seen, F.expr(second) == F.col("_second"), "left_anti")


def appended(batch: DataFrame, history: DataFrame, highest: int | None = None) -> DataFrame:
    """The captures of a batch that are new, numbered and in table order; loading a batch twice adds nothing.

    ``highest`` is the last number given, where the table keeps it.
    """
    new = not_yet_captured(batch, history, bounded=True)
    numbered = numbered_by(new, history if highest is None else highest, "snapshot_id", F.to_date("captured_at"), ["captured_at"])
    return numbered.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in KPI_SNAPSHOTS.fields))


def listing(history: DataFrame) -> DataFrame:
    """All captures, oldest first, with an empty text for a missing label."""
    return history.withColumn("label", F.coalesce("label", F.lit(""))).orderBy("captured_at")


def without_label(history: DataFrame, text: str) -> DataFrame:
    """Drop captures whose label contains ``text``; captures without a label stay."""
    return history.where(~F.coalesce(F.col("label").contains(text), F.lit(False)))


def to_long(history: DataFrame, columns: Iterable[str] = (*SCORE_COLUMNS, *KPI_COLUMNS)) -> DataFrame:
    """Wide captures -> ``captured_at, label, kpi_id, value``."""
    return history.unpivot(["captured_at", "label"], list(columns), "kpi_id", "value")


def with_delta(long_history: DataFrame) -> DataFrame:
    """Change against the previous capture of the same KPI; NULL for the first."""
    previous = F.lag("value").over(Window.partitionBy("kpi_id").orderBy(F.asc_nulls_last("captured_at")))
    return long_history.withColumn("delta", (rates.tenths(F.col("value")) - rates.tenths(previous)) / 10.0)


def trend(long_history: DataFrame) -> DataFrame:
    """``kpi_id, n_captures, first_value, last_value, sentence`` per KPI."""
    ends = long_history.groupBy("kpi_id").agg(
        F.count(F.lit(1)).alias("n_captures"),
        F.min_by("value", "captured_at").alias("first_value"),
        F.max_by("value", "captured_at").alias("last_value"),
    )
    first, last = F.col("first_value"), F.col("last_value")
    verb = F.when(last < first, "declined").when(last > first, "rose").otherwise("stayed")
    told = F.format_string("Over %d captures it %s from %.1f%% to %.1f%%.", "n_captures", verb, first, last)
    return ends.withColumn(
        "sentence", F.when(F.col("n_captures") >= 2, told).otherwise("No trend yet.")
    )


def rates_by_period(df: DataFrame, rules: Iterable[Rule], period: Column) -> DataFrame:
    """Row rates of one table per period: ``captured_at, kpi_id, num, den, value``.

    One scan and one aggregate for all rules, used to fill a history from dated rows.
    """
    rules = list(rules)
    if any(not isinstance(r.measure, RowRate) for r in rules):
        raise TypeError("only row rates can be counted per period")
    counts = [
        c
        for i, r in enumerate(rules)
        for c in (
            F.count_if(F.expr(r.measure.hit)).alias(f"num_{i}"),
            F.count_if(F.expr(r.measure.among)).alias(f"den_{i}"),
        )
    ]
    rows = [
        F.struct(F.lit(r.kpi_id).alias("kpi_id"), F.col(f"num_{i}").alias("num"), F.col(f"den_{i}").alias("den"))
        for i, r in enumerate(rules)
    ]
    counted = df.groupBy(period.alias("captured_at")).agg(*counts)
    listed = counted.select("captured_at", F.inline(F.array(*rows)))
    return listed.withColumn("value", rates.pct(F.col("num"), F.col("den")))


def overall_by_period(long_history: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """``captured_at, kpi_id, value``: the mean score of the scored KPIs that were counted in a period.

    ``long_history`` has ``captured_at, kpi_id, value``, as ``rates_by_period`` makes it.
    """
    rules = list(rules)
    rated = with_parts(with_rule(long_history, rules, "target_val", "higher_is_better"), rules)
    mean = rated.groupBy("captured_at").agg(overall_mean().alias("value"))
    return mean.select("captured_at", F.lit("overall_score").alias("kpi_id"), "value")
