"""Failing rows of many rules in one pass per table: every row is tagged with the rules it breaks.

Row rules of one table share a scan, or the join behind a view. A row's tags are an array with the id of each rule it
breaks, NULL in the places of the others; rows that break none go no further, which filters can see to at the scan. Both
are plain expressions that Spark compiles, without functions over arrays. Rules that relate two tables have rows of their own and are stacked beside them.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepulse.operators.drilldown import failing_rows
from tablepulse.operators.rules import RowRate, Rule, Tables

TAGS = "kpi_ids"


def passes(rules: Iterable[Rule]) -> tuple[dict[str, list[Rule]], list[Rule]]:
    """Drillable row rules by table, and the other drillable rules."""
    by_table: dict[str, list[Rule]] = {}
    keyed = []
    for rule in rules:
        if rule.drillable and isinstance(rule.measure, RowRate):
            by_table.setdefault(rule.measure.table, []).append(rule)
        elif rule.drillable:
            keyed.append(rule)
    return by_table, keyed


def tags(rules: Iterable[Rule]) -> Column:
    """The ids of the row rules that a row breaks, each in its rule's place."""
    return F.array(*(F.when(F.expr(r.measure.hit), F.lit(r.kpi_id)) for r in rules)).alias(TAGS)


def breaks_any(rules: Iterable[Rule]) -> Column:
    return reduce(lambda a, b: a | b, (F.expr(r.measure.hit) for r in rules))


def failing_keys(tables: Tables, rules: Iterable[Rule], keys: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``kpi_ids, row_key, row_no``: what names each failing row, once per row however many rules it breaks.

    ``keys`` gives both as expressions over the rows a rule shows; rules of one table that name their rows differently
    are tagged apart.
    """
    by_table, keyed = passes(rules)
    parts = []
    for table, group in by_table.items():
        by_key: dict[tuple[str, str], list[Rule]] = {}
        for rule in group:
            by_key.setdefault(keys[rule.kpi_id], []).append(rule)
        for (key, number), same in by_key.items():
            rows = tables[table].where(breaks_any(same))
            parts.append(rows.select(tags(same), F.expr(key).cast("long").alias("row_key"), F.expr(number).cast("int").alias("row_no")))
    for rule in keyed:
        key, number = keys[rule.kpi_id]
        found = failing_rows(tables, rule)
        parts.append(found.select(F.array(F.lit(rule.kpi_id)).alias(TAGS), F.expr(key).cast("long").alias("row_key"), F.expr(number).cast("int").alias("row_no")))
    return reduce(DataFrame.unionAll, parts)
