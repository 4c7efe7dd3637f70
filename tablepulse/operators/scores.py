"""From counts to values, scores, status and roll-ups.

After ``measure`` there is one row per rule, so everything here works on a handful of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tablepulse.functions import rates
from tablepulse.operators.measure import measure
from tablepulse.operators.rules import Entity, Rule, Tables, local_frame, with_rule

# Labels per breakdown in the payload; the rest are in ``breakdown``.
MOST_LABELS = 50
KPI_COLUMNS = ("kpi_id", "num", "den", "value", "target_val", "higher_is_better")


def kpi_table(tables: Tables, rules: Iterable[Rule]) -> DataFrame:
    """``kpi_id, num, den, value, target_val, higher_is_better`` — one row per rule."""
    rules = list(rules)
    counted = measure(tables, rules).withColumn("value", rates.pct(F.col("num"), F.col("den")))
    return with_rule(counted, rules, "target_val", "higher_is_better").select(*KPI_COLUMNS)


def pinned(kpis: DataFrame) -> DataFrame:
    """The KPI table measured now and kept as a local table, for several uses of one measurement.

    It has one row per rule, however much data was measured.
    """
    columns = kpis.select(*KPI_COLUMNS)
    rows = [row.asDict() for row in columns.collect()]
    return local_frame(kpis.sparkSession, rows, to_arrow_schema(columns.schema))


def _against_target(function, kpis: DataFrame):
    return function(F.col("value"), F.col("target_val"), F.col("higher_is_better"))


def with_scores(kpis: DataFrame) -> DataFrame:
    return kpis.withColumn("score", _against_target(rates.score, kpis))


def with_status(kpis: DataFrame) -> DataFrame:
    return kpis.withColumn("status", _against_target(rates.rag, kpis))


def with_deviation(kpis: DataFrame) -> DataFrame:
    return kpis.withColumn("deviation", _against_target(rates.deviation, kpis))


def mean_percent(percent: Column, among: Column) -> Column:
    """Aggregate: mean of one-decimal numbers as an integer, from an exact sum of tenths."""
    counted = F.when(among, rates.tenths(percent))
    return rates.round_half_even(F.sum(counted) / (F.count(counted) * F.lit(10.0)))


def with_parts(kpis: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Scores, catalogue columns, and ``part``: what a KPI contributes to its pillar."""
    rated = with_rule(with_scores(kpis), rules, "ordinal", "pillar", "component", "scored")
    clean = F.when(F.col("higher_is_better"), F.col("value")).otherwise(100 - F.col("value"))
    return rated.withColumn("part", F.when(F.col("component") == "score", F.col("score")).otherwise(clean))


def overall_mean() -> Column:
    """Aggregate over ``with_parts``: mean score of the scored KPIs."""
    return mean_percent(F.col("score"), F.col("scored"))


def pillar_mean(pillar: str) -> Column:
    """Aggregate over ``with_parts``: mean part of the scored KPIs of a pillar."""
    return mean_percent(F.col("part"), F.col("scored") & (F.col("pillar") == pillar))


def pillar_scores(kpis: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """``pillar, pillar_score``: mean of the clean shares of its KPIs, or of their scores."""
    scored = with_parts(kpis, rules).where("scored")
    return scored.groupBy("pillar").agg(mean_percent(F.col("part"), F.lit(True)).alias("pillar_score"))


def overall_score(kpis: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """``overall_score, n_kpis``: mean score of the scored KPIs."""
    return with_parts(kpis, rules).agg(
        overall_mean().alias("overall_score"), F.count_if(F.col("scored")).alias("n_kpis")
    )


def _total(kpi_ids: Iterable[str], amount: Column) -> Column:
    listed = list(kpi_ids)
    if not listed:
        return F.lit(0).cast("long")
    return F.coalesce(F.sum(F.when(F.col("kpi_id").isin(*listed), amount)), F.lit(0)).cast("long")


def entity_sums(entities: Iterable[Entity]) -> list[Column]:
    """Aggregates ``bad_i, rows_i`` per entity over a KPI table."""
    sums = []
    for i, e in enumerate(entities):
        bad = _total(e.bad, F.col("num")) + _total(e.missing, F.col("den") - F.col("num"))
        sums += [bad.alias(f"bad_{i}"), _total([e.total_of], F.col("den")).alias(f"rows_{i}")]
    return sums


def entity_struct(i: int, entity: Entity) -> Column:
    """``struct(entity, bad_rows, total_rows, entity_score)`` from the sums.

    A row may break several rules, so the sum of failures is cut at the row count.
    """
    rows = F.col(f"rows_{i}")
    bad = F.least(F.col(f"bad_{i}"), rows)
    return F.struct(
        F.lit(entity.name).alias("entity"),
        bad.alias("bad_rows"),
        rows.alias("total_rows"),
        rates.pct(rows - bad, rows).alias("entity_score"),
    )


def entity_scores(kpis: DataFrame, entities: Iterable[Entity]) -> DataFrame:
    """``entity, bad_rows, total_rows, entity_score``: share of rows no rule objects to."""
    entities = list(entities)
    structs = [entity_struct(i, e) for i, e in enumerate(entities)]
    return kpis.agg(*entity_sums(entities)).select(F.inline(F.array(*structs)))


def breakdown(df: DataFrame, column: str) -> DataFrame:
    """``label, n``: frequencies, most frequent first."""
    counted = df.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "label")


def breakdown_lists(breakdowns: Mapping[str, tuple[DataFrame, str]], most: int = MOST_LABELS) -> DataFrame | None:
    """``name, rows array<struct<label, count>>``: up to ``most`` labels of every breakdown, most frequent first.

    All columns of one table are counted in one scan. Ranks are cut in every task before the shuffle.
    """
    by_table: dict[int, list[tuple[str, DataFrame, str]]] = {}
    for name, (df, column) in breakdowns.items():
        by_table.setdefault(id(df), []).append((name, df, column))
    parts = []
    for group in by_table.values():
        pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("label")) for n, _, c in group))
        parts.append(group[0][1].select(F.inline(pairs)).groupBy("name", "label").agg(F.count(F.lit(1)).alias("n")))
    if not parts:
        return None
    order = Window.partitionBy("name").orderBy(F.desc("n"), F.asc_nulls_first("label"))
    first = reduce(DataFrame.unionAll, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    ranked = F.array_sort(F.collect_list(F.struct("rank", "label", "n")))
    return first.groupBy("name").agg(
        F.transform(ranked, lambda r: F.struct(r["label"].alias("label"), r["n"].alias("count"))).alias("rows")
    )


def payload(
    kpis: DataFrame,
    rules: Iterable[Rule],
    entities: Iterable[Entity],
    breakdowns: Mapping[str, tuple[DataFrame, str]],
    computed_at: Column | None = None,
) -> DataFrame:
    """Everything a report needs as one nested row.

    ``computed_at, counts map, overall_score, pillar_scores map, entity_scores map, kpis map<id, struct>,
    breakdowns map<name, array<struct>>``. The KPI table is read once. All inputs are roll-ups whose size is set by the
    rules and by ``MOST_LABELS``, not by the data; they are stacked and folded by one aggregate, so no one-row
    relations have to be crossed.
    """
    rules, entities = list(rules), list(entities)
    pillars = sorted({r.pillar for r in rules if r.scored})
    target = rates.target_text(F.col("target_val"), F.col("higher_is_better")).alias("target")
    kpi = F.struct("value", "num", "den", target, "target_val", "higher_is_better")
    rolled = with_parts(kpis, rules).agg(
        overall_mean().alias("overall_score"),
        F.map_from_arrays(
            F.array(*map(F.lit, pillars)), F.array(*map(pillar_mean, pillars))
        ).alias("pillar_scores"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("kpi_id", kpi)))).alias("kpis"),
        *entity_sums(entities),
    )

    def by_entity(field: str) -> Column:
        named = sorted(enumerate(entities), key=lambda pair: pair[1].name)
        return F.map_from_entries(F.array(*(F.struct(F.lit(e.name), entity_struct(i, e)[field]) for i, e in named)))

    rolled = rolled.select(
        by_entity("total_rows").alias("counts"),
        "overall_score",
        "pillar_scores",
        by_entity("entity_score").alias("entity_scores"),
        "kpis",
    )
    listed = breakdown_lists(breakdowns)
    if listed is not None:
        rolled = rolled.unionByName(listed.select(F.struct("name", "rows").alias("breakdown")), allowMissingColumns=True)
    else:
        rolled = rolled.withColumn("breakdown", F.lit(None).cast("struct<name:string,rows:array<struct<label:string,count:bigint>>>"))
    single = ("counts", "overall_score", "pillar_scores", "entity_scores", "kpis")
    folded = rolled.agg(
        *(F.any_value(c, True).alias(c) for c in single),
        F.map_from_entries(F.array_sort(F.collect_list("breakdown"))).alias("breakdowns"),
    )
    moment = F.current_timestamp() if computed_at is None else computed_at
    return folded.select(rates.utc_text(moment).alias("computed_at"), "*")


def report(kpis: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """``ordinal, pillar, line``: the KPI table as lines of text, in catalogue order."""
    listed = with_rule(kpis, rules, "ordinal", "pillar", "name")
    dashed = F.regexp_replace("kpi_id", r"^([A-Z]+)([0-9])", "$1-$2")
    target = rates.target_text(F.col("target_val"), F.col("higher_is_better"))
    line = F.format_string("%s %s: %d/%d = %.1f%% (target %s)", dashed, "name", "num", "den", "value", target)
    return listed.select("ordinal", "pillar", line.alias("line")).orderBy("ordinal")
