"""NULL and duplicate-key behaviour, one small table per case."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablepulse.functions import rates
from tablepulse.operators import fixes
from tablepulse.operators.drilldown import failing_rows
from tablepulse.operators.joins import not_in
from tablepulse.operators.measure import measure
from tablepulse.operators.rules import find_rule
from tablepulse.plans import corrections
from tablepulse.plans.freight import RULES
from tablepulse.sources import schemas, sinks


def tables(spark, order=(), link=(), shipment=()):
    """Rows as tuples of the columns that matter."""
    orders = [{"order_release_gid": g, "total_weight_kg": w} for g, w in order]
    links = [
        {"os_id": str(i), "order_release_gid": o, "shipment_gid": s, "quantity_kg": q, "lake_status": a}
        for i, (o, s, q, a) in enumerate(link)
    ]
    rows = {"order": orders, "order_shipment": links, "shipment": list(shipment)}
    return {n: sinks.literal_batch(spark, rows[n], schemas.TABLES[n]) for n in rows}


def counted(found_tables, kpi_id):
    row = measure(found_tables, [find_rule(RULES, kpi_id)]).first()
    return row.num, row.den


def test_null_status_is_neither_invalid_nor_started(spark):
    t = tables(spark, shipment=[{"status": s} for s in (None, "Odd", "Closed", "Planned")])
    assert counted(t, "RI01") == (1, 4)
    assert counted(t, "CP05") == (2, 2)


def test_null_weight_is_not_zero(spark):
    t = tables(spark, order=[("a", None), ("b", 0.0), ("c", -1.0), ("d", 5.0)])
    assert counted(t, "RI05") == (2, 4)
    fixed = fixes.apply_all(t, [corrections.ZERO_WEIGHT])
    assert counted(fixed, "RI05") == (0, 4)


def test_null_order_key_is_an_orphan(spark):
    t = tables(spark, order=[("a", 1.0), (None, 1.0)], link=[(None, "s", 1.0, "Active"), ("a", "s", 1.0, "Active")])
    assert counted(t, "JI02") == (1, 2)
    assert [r.order_release_gid for r in failing_rows(t, find_rule(RULES, "JI02")).collect()] == [None]
    assert fixes.apply(t, corrections.ORPHANS).count() == 1


def test_duplicate_shipments_push_the_resolve_rate_up(spark):
    t = tables(
        spark,
        link=[("a", "s", 1.0, "Active"), ("b", None, 1.0, "Active"), ("c", "s", 1.0, "STALE")],
        shipment=[{"shipment_gid": g} for g in ("s", "s", None)],
    )
    assert counted(t, "JI03") == (4, 3)


def test_reconciliation_groups(spark):
    t = tables(
        spark,
        order=[
            ("twice", 10.0), ("twice", 10.0),  # one group, sum counted twice: 20 against 10
            ("differ", 10.0), ("differ", 20.0),  # two groups, 10 fits the first only
            ("mixed", 10.0), ("mixed", None), ("mixed", 11.0), ("mixed", 11.0),  # 10 fits; 2 x 10 against 11
            ("idle", 10.0),  # no active link: not tested
            ("unknown", None),  # NULL weight drops out
            ("negative", -10.0),  # always off
            (None, 10.0),
        ],
        link=[
            ("twice", "s", 10.0, "Active"), ("differ", "s", 6.0, "Active"), ("differ", "s", 4.0, "Active"),
            ("mixed", "s", 10.0, "Active"), ("idle", "s", 3.0, "STALE"), ("unknown", "s", 3.0, "Active"),
            ("negative", "s", -10.0, "Active"), (None, "s", 3.0, "Active"),
        ],
    )
    assert counted(t, "CS01") == (4, 12)
    shown = failing_rows(t, find_rule(RULES, "CS01")).collect()
    assert sorted((r.order_release_gid, r.order_weight_kg, r.shipment_weight_sum_kg) for r in shown) == [
        ("differ", 20.0, 10.0), ("mixed", 11.0, 20.0), ("negative", -10.0, -10.0), ("twice", 10.0, 20.0),
    ]


def test_ambiguity_counts_link_keys_but_shows_orders(spark):
    t = tables(
        spark,
        order=[("a", 1.0), ("b", 1.0)],
        link=[
            ("a", "s1", 1.0, "Active"), ("a", "s2", 1.0, "Active"), ("a", None, 1.0, "Active"),
            ("gone", "s1", 1.0, "Active"), ("gone", "s2", 1.0, "Active"),
            (None, "s1", 1.0, "Active"), (None, "s2", 1.0, "Active"),
            ("b", "s1", 1.0, "Active"), ("b", "s2", 1.0, "STALE"),
        ],
    )
    assert counted(t, "CS07") == (3, 2)
    shown = failing_rows(t, find_rule(RULES, "CS07")).collect()
    assert [(r.order_release_gid, r.active_shipment_count) for r in shown] == [("a", 2)]


def test_match_counts_keys_but_divides_by_rows(spark):
    t = tables(
        spark,
        order=[("a", 1.0), ("a", 1.0), ("b", 1.0), (None, 1.0)],
        link=[("a", "s", 1.0, "Active"), ("b", "s", 1.0, "STALE"), (None, "s", 1.0, "Active")],
    )
    assert counted(t, "JI01") == (1, 4)
    unmatched = failing_rows(t, find_rule(RULES, "JI01")).collect()
    assert sorted(str(r.order_release_gid) for r in unmatched) == ["None", "b"]


def test_lateness_may_exceed_its_denominator(spark):
    import datetime as dt

    late = {"planned_delivery": dt.date(2025, 1, 1), "actual_arrival": dt.date(2025, 1, 2)}
    t = tables(spark, shipment=[{**late, "status": s} for s in ("Planned", "Cancelled", "Closed")])
    assert counted(t, "TP01") == (3, 1)


def test_empty_tables(spark):
    t = tables(spark)
    rows = {r.kpi_id: (r.num, r.den) for r in measure(t, RULES).collect()}
    assert set(rows.values()) == {(0, 0)} and len(rows) == len(RULES)
    value = rates.pct(F.lit(0), F.lit(0))
    lower = rates.score(value, F.lit(0.0), F.lit(False))
    higher = rates.score(value, F.lit(98.0), F.lit(True))
    assert spark.range(1).select(value, lower, higher).first()[:] == (0.0, 100.0, 0.0)


@pytest.mark.parametrize("right,expected", [([1], [2]), ([1, None], []), ([], [None, 1, 2])])
def test_not_in(spark, right, expected):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    present = spark.createDataFrame([(x,) for x in right], "b int")
    found = [r.a for r in not_in(left, "a", present, "b").collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_delete_keeps_rows_without_an_answer(spark):
    t = {"t": spark.createDataFrame([("x",), ("y",), (None,)], "s string")}
    kept = fixes.apply(t, fixes.Delete("d", "t", "s = 'x'"))
    assert sorted(str(r.s) for r in kept.collect()) == ["None", "y"]


def test_update_reads_the_old_row(spark):
    t = {"t": spark.createDataFrame([(1, 2), (5, 6)], "a int, b int")}
    swapped = fixes.apply(t, fixes.Update("swap", "t", "a = 1", {"a": "b", "b": "a"}))
    assert sorted((r.a, r.b) for r in swapped.collect()) == [(2, 1), (5, 6)]
