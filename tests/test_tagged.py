"""Failing rows found in one pass per table, and evidence, are those that each rule finds on its own."""

from __future__ import annotations

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablepulse.operators.drilldown import drilldown, failing_rows
from tablepulse.operators.rootcause import evidence
from tablepulse.operators.rules import RowRate, Rule
from tablepulse.operators.tagged import failing_keys
from tablepulse.plans.freight import RULES

DRILLABLE = [r for r in RULES if r.drillable]


def plain(value):
    return value.isoformat() if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_first_rows_are_the_drill_down(freight, limit):
    found = {r.kpi_id: [json.loads(x) for x in r.evidence] for r in evidence(freight, DRILLABLE, limit).collect()}
    for rule in DRILLABLE:
        rows = [{k: plain(v) for k, v in r.asDict().items()} for r in drilldown(freight, RULES, rule.kpi_id, limit).collect()]
        assert found.get(rule.kpi_id, []) == json.loads(json.dumps(rows)), rule.kpi_id


def test_rules_of_one_table_with_other_names_orders_and_types(spark):
    """Rules that show different expressions under one name, order either way, and share rows."""
    rows = spark.range(60).selectExpr(
        "IF(id % 11 = 0, NULL, id) AS a", "CAST(id % 7 AS STRING) AS b", "CAST(id % 5 AS DOUBLE) AS c", "date_add(DATE '2024-01-01', CAST(id AS INT)) AS d"
    )
    rules = [
        Rule("X1", "", "p", "o", 0, False, RowRate("t", "c > 2"), show=("a", "d AS x"), order=("-x",)),
        Rule("X2", "", "p", "o", 0, False, RowRate("t", "b = '3' OR a IS NULL"), show=("b AS x", "a"), order=("x", "-a")),
        Rule("X3", "", "p", "o", 0, False, RowRate("t", "c > 2"), show=("a", "d AS x"), order=("-x",)),
        Rule("X4", "", "p", "o", 0, False, RowRate("t", "false"), show=("a",)),
    ]
    found = {r.kpi_id: [json.loads(x) for x in r.evidence] for r in evidence({"t": rows}, rules, 9).collect()}
    for rule in rules:
        want = [{k: plain(v) for k, v in r.asDict().items()} for r in drilldown({"t": rows}, rules, rule.kpi_id, 9).collect()]
        assert found.get(rule.kpi_id, []) == want
    assert found["X1"] == found["X3"] and len(found["X1"]) == 9 and "X4" not in found


def test_keys_name_every_failing_row_once(freight):
    named = {r.kpi_id: (f"xxhash64({r.show[0]})" if r.show[0].isidentifier() else "0", "0") for r in DRILLABLE}
    first = {r.kpi_id: r.show[0] for r in DRILLABLE}
    keys = failing_keys(freight, DRILLABLE, named)
    got = Counter((k, r.row_key) for r in keys.collect() for k in r.kpi_ids if k)
    want = Counter()
    for rule in DRILLABLE:
        expression = named[rule.kpi_id][0]
        name = first[rule.kpi_id].rsplit(" AS ", 1)[-1]
        shown = failing_rows(freight, rule).select(F.xxhash64(name).alias("k") if expression != "0" else F.lit(0).alias("k"))
        want.update((rule.kpi_id, r.k) for r in shown.collect())
    assert got == want
    by_row = Counter(tuple(k for k in r.kpi_ids if k) for r in keys.collect())
    assert any(len(ids) > 1 for ids in by_row), "a row that breaks several rules is listed once"
