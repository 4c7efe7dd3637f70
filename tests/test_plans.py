"""What the physical plans must and must not contain."""

from __future__ import annotations

import os
import re
from collections import Counter

import pytest

from tablepulse.plans import warehouse
from tablepulse.plans.queries import QUERIES
from tests.conftest import TESTDATA

FOLDER = f"{TESTDATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_auto_broadcast(spark):
    """Plans as for tables far above the broadcast threshold."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_no_python_and_only_catalogues_broadcast(spark, no_auto_broadcast, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "Scan ExistingRDD"):
        assert word not in plan
    # With automatic broadcasts off, every broadcast that is left is of a fixed list in the plan.
    assert plan.count("BroadcastExchange") <= plan.count("LocalTableScan")


def test_one_shuffle_of_the_lines_for_all_rules_of_a_key(spark):
    rules = [r for r in warehouse.RULES if r.kpi_id in ("JI01", "JI02", "CS07", "BIZ03")]
    from tablepulse.operators.measure import measure

    plan = plan_of(measure(warehouse.load(spark, FOLDER), rules))
    found = Counter(re.findall(r"Exchange hashpartitioning|FileScan|Join", plan))
    assert found == {"Exchange hashpartitioning": 1, "FileScan": 2}
    reconciled = [*rules, *(r for r in warehouse.RULES if r.kpi_id == "CS01")]
    counted = measure(warehouse.load(spark, FOLDER), reconciled)
    counted.collect()
    plan = plan_of(counted).split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan.*lineitem", plan)) == 1 and len(re.findall(r"FileScan.*orders", plan)) == 2
    assert "ReusedExchange" in plan, "keys with one and with several amounts share the shuffle of records"


def test_kpi_table_scans_the_lines_three_times(spark):
    """Once for all rules by order key and the row rates, once by supplier key, once for the join with order dates."""
    counted = QUERIES["kpi_table"](spark, FOLDER)
    counted.collect()
    plan = plan_of(counted).split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan.*lineitem", plan)) == 3


def test_before_and_after_are_one_measurement(spark):
    compared = QUERIES["fix_before_after"](spark, FOLDER)
    compared.collect()
    plan = plan_of(compared).split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan.*lineitem", plan)) == 3


WRITERS = (
    "export_failing_rows", "reload_and_append", "latest_version", "derived_appended", "captures_appended",
    "failing_samples", "alerts_in_review", "alerts_resolved", "load_report", "bucketed_line_rates",
)
# These compare the files of the counted tables with those that the stored counts come from.
LISTED_FIRST = (
    "history", "history_delta", "history_overall", "history_trend", "history_without_label", "chat_replies", "compact_context",
)


def test_building_a_query_runs_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    for name in sorted(set(QUERIES) - set(WRITERS) - set(LISTED_FIRST)):
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        QUERIES[name](spark, FOLDER)
        assert list(tracker.getJobIdsForGroup(f"build-{name}")) == [], name
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_one_scan_for_all_row_rates_of_a_table(spark):
    rules = [r for r in warehouse.RULES if r.kpi_id in ("RI05", "BIZ02")]
    from tablepulse.operators.measure import measure

    plan = plan_of(measure(warehouse.load(spark, FOLDER), rules))
    assert plan.count("FileScan") == 1
    assert re.search(r"ReadSchema: struct<c_acctbal:double>", plan)


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["drilldown_biz03"](spark, FOLDER))
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in plan
    assert "l_extendedprice" not in plan
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("name", ["conversation_tail", "failing_samples"])
def test_rank_filters_run_before_the_shuffle(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert re.search(r"WindowGroupLimit.*Final", plan) and re.search(r"WindowGroupLimit.*Partial", plan)


def test_bucketed_lines_meet_their_orders_without_a_shuffle(spark, no_auto_broadcast):
    from tablepulse.operators.drilldown import failing_rows
    from tablepulse.operators.measure import measure
    from tablepulse.operators.rules import find_rule
    from tablepulse.plans.queries import bucketed_line_rates

    tables = {}
    original = warehouse.bucketed
    try:
        warehouse.bucketed = lambda *args: tables.setdefault("t", original(*args))
        bucketed_line_rates(spark, FOLDER)
    finally:
        warehouse.bucketed = original
    rules = [find_rule(warehouse.RULES, k) for k in ("CS02", "TP01", "BIZ01")]
    below_join = plan_of(measure(tables["t"], rules)).split("SortMergeJoin", 1)[1]
    assert "Exchange" not in below_join and "Bucketed: true" in below_join
    for kpi_id in ("TP01", "JI02"):
        plan = plan_of(failing_rows(tables["t"], find_rule(warehouse.RULES, kpi_id)))
        assert "Join" in plan and ("Exchange" not in plan or kpi_id == "JI02")


def test_failing_rows_are_named_in_one_pass_per_table(spark):
    """Row rules of a table share its scan, and the samples read the list of keys alone."""
    from tablepulse.operators.tagged import failing_keys
    from tablepulse.plans.queries import DRILLDOWNS, ROW_KEYS
    from tablepulse.operators.rules import find_rule

    rules = [find_rule(warehouse.RULES, k) for k in DRILLDOWNS]
    found = Counter(re.findall(r"FileScan.*?/(\w+)\.parquet", plan_of(failing_keys(warehouse.load(spark, FOLDER), rules, ROW_KEYS))))
    assert (found["events"], found["customer"], found["documents"]) == (1, 1, 1)
    plan = plan_of(QUERIES["failing_samples"](spark, FOLDER))
    assert "failing-keys" in plan and not re.search(r"FileScan.*?/\w+\.parquet", plan)
