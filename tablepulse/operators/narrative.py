"""Short texts made from tables: summary paragraph, conversation tail, compact context."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablepulse.functions import rates, text
from tablepulse.operators.history import trend
from tablepulse.operators.rules import Rule
from tablepulse.operators.scores import overall_mean, pillar_mean, pillar_scores, with_deviation, with_parts, with_status

LAST_TURNS = 5

Topics = Iterable[tuple[str, Iterable[str]]]


def headline(kpis: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """One row: the overall score, the red KPI furthest from its target, and the first spotless KPI."""
    rated = with_parts(with_deviation(with_status(kpis)), rules).where("scored")
    spotless = rates.meets_target(F.col("value"), F.col("target_val"), F.col("higher_is_better"))
    red = F.col("status") == "RED"
    kpi = F.struct("kpi_id", "value", "target_val")
    # Among equally bad KPIs the earlier one in the catalogue wins.
    badness = F.when(red, F.struct("deviation", (-F.col("ordinal")).alias("position")))
    return rated.agg(
        overall_mean().alias("overall_score"),
        F.max_by(kpi, badness).alias("worst"),
        F.min_by(kpi, F.when(spotless, F.col("ordinal"))).alias("best"),
    )


def summary(kpis: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """``worst_kpi, best_kpi, overall_score, summary`` — one row."""
    facts = headline(kpis, rules)
    opening = F.format_string("Overall data quality is at %.0f%%.", "overall_score")
    worst = F.when(
        F.col("worst").isNotNull(),
        F.format_string(
            "The most pressing issue is %s at %.1f%% against a target of %.1f%%.",
            "worst.kpi_id", "worst.value", "worst.target_val",
        ),
    )
    best = F.when(
        F.col("best").isNotNull(),
        F.format_string(
            "On the positive side, %s stands at %.1f%% and meets its target of %.1f%%.",
            "best.kpi_id", "best.value", "best.target_val",
        ),
    )
    closing = F.lit("Next step: raise alerts and look into the root cause of the most pressing one.")
    return facts.select(
        F.col("worst.kpi_id").alias("worst_kpi"),
        F.col("best.kpi_id").alias("best_kpi"),
        "overall_score",
        F.concat_ws(" ", opening, worst, best, closing).alias("summary"),
    )


def conversation_tail(turns: DataFrame, limit: int = LAST_TURNS) -> DataFrame:
    """``conv_id, n_turns, preamble``: the last turns of each conversation, oldest first.

    The rank filter runs in every task before the shuffle, so a conversation of any length sends at
    most ``limit`` turns per task, and the collected list never exceeds ``limit`` entries.
    """
    line = F.concat(
        F.lit("\n"), F.initcap(F.coalesce("role", F.lit("user"))), F.lit(": "), F.coalesce("text", F.lit(""))
    )
    lines = turns.select("conv_id", "turn", line.alias("line"))
    newest_first = Window.partitionBy("conv_id").orderBy(F.desc_nulls_last("turn"), F.desc("line"))
    last = lines.withColumn("_rank", F.row_number().over(newest_first)).where(F.col("_rank") <= limit)
    listed = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("_rank")).alias("n"), "line"))).alias("t"))
    return listed.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: x["line"]), "").alias("preamble"),
    )


def replies(
    messages: DataFrame, kpis: DataFrame, rules: Iterable[Rule], long_history: DataFrame, topics: Topics = text.TOPICS
) -> DataFrame:
    """The messages with ``topic, reply``: an answer from the current KPIs for the topic of each message.

    The facts are a few numbers, read once as a scalar subquery; messages are only projected.
    """

    def fact(kpi_id: str) -> list[Column]:
        named = F.col("kpi_id") == kpi_id
        return [F.max(F.when(named, F.col(c))).alias(f"{kpi_id}_{c}") for c in ("value", "num")]

    rules = list(rules)
    scores = (F.struct(pillar_mean(p).alias("score"), F.lit(p).alias("pillar")) for p in sorted({r.pillar for r in rules if r.scored}))
    weakest = F.array_min(F.filter(F.array(*scores), lambda x: x["score"].isNotNull())).alias("weakest")
    told = trend(long_history.where("kpi_id = 'overall_score'")).agg(F.max("sentence")).scalar()
    facts = (
        with_parts(kpis, rules)
        .agg(overall_mean().alias("overall"), F.count_if("scored").alias("n"), weakest, *fact("CS07"), *fact("JI02"))
        .select(F.struct("*").alias("facts"))
        .scalar()
    )
    asked = messages.withColumns({"topic": text.route(F.col("text"), topics), "_f": facts, "_trend": told})
    overall = F.format_string("The overall score is %.0f%%, the mean of %d KPIs.", "_f.overall", "_f.n")
    pillar = F.format_string("The weakest pillar is %s at %.0f%%.", "_f.weakest.pillar", F.col("_f.weakest.score").cast("double"))
    unknown = F.lit("This KPI has not been measured.")

    def kpi(kpi_id: str, label: str) -> Column:
        value, num = F.col(f"_f.{kpi_id}_value"), F.col(f"_f.{kpi_id}_num")
        told = F.format_string(f"{label} is at %.1f%% (%d rows); the drill-down lists them.", value, num)
        return F.when(value.isNotNull(), told).otherwise(unknown)

    answer = (
        F.when(F.col("topic") == "ghost", kpi("CS07", "CS07"))
        .when(F.col("topic") == "orphan", kpi("JI02", "JI02"))
        .when(F.col("topic") == "fix", "Open the alert, read its root cause, check the dry run, then approve the fix.")
        .when(F.col("topic") == "trend", F.coalesce("_trend", F.lit("No trend yet.")))
        .when((F.col("topic") == "overall") & F.col("_f.weakest").isNotNull(), F.concat_ws(" ", overall, pillar))
        .otherwise(overall)
    )
    return asked.withColumn("reply", answer).drop("_f", "_trend")


def compact_context(
    kpis: DataFrame, history: DataFrame, rules: Iterable[Rule] = (), open_alerts: DataFrame | None = None
) -> DataFrame:
    """``kind, name, body``: of a KPI only value and target, of a capture only label and score.

    With ``rules`` also the score of every pillar, with ``open_alerts`` the number of open alerts by KPI and severity.
    """
    target = rates.target_text(F.col("target_val"), F.col("higher_is_better")).alias("target")
    of_kpi = kpis.select(
        F.lit("kpi").alias("kind"), F.col("kpi_id").alias("name"), F.to_json(F.struct("value", target)).alias("body")
    )
    of_capture = history.select(
        F.lit("capture"),
        F.coalesce("label", F.lit("")),
        F.to_json(F.struct(F.coalesce("label", F.lit("")).alias("label"), "overall_score")),
    )
    context = of_kpi.unionAll(of_capture)
    rules = list(rules)
    if rules:
        pillars = pillar_scores(kpis, rules)
        context = context.unionAll(pillars.select(F.lit("pillar"), "pillar", F.to_json(F.struct("pillar_score"))))
    if open_alerts is not None:
        counted = open_alerts.groupBy("kpi_id", "severity").agg(F.count(F.lit(1)).alias("n_alerts"))
        context = context.unionAll(
            counted.select(F.lit("alert"), F.coalesce("kpi_id", F.lit("")), F.to_json(F.struct("severity", "n_alerts")))
        )
    return context
