"""Golden values of the freight model on the generated data set."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablepulse.operators import alerts, fixes, narrative, rootcause, scores
from tablepulse.operators.drilldown import drilldown, failing_rows
from tablepulse.operators.history import capture
from tablepulse.operators.measure import row_counts
from tablepulse.operators.rules import find_rule
from tablepulse.plans import corrections, wording
from tablepulse.plans.freight import BREAKDOWNS, ENTITIES, RULES
from tablepulse.sources import schemas, sinks

GOLDEN = {
    # kpi: (num, den, value, score, status)
    "JI01": (94, 100, 94.0, 95.9, "AMBER"),
    "JI02": (3, 113, 2.7, 83.0, "RED"),
    "JI03": (113, 113, 100.0, 100.0, "GREEN"),
    "CP01": (0, 100, 0.0, 100.0, "GREEN"),
    "CP02": (0, 111, 0.0, 100.0, "GREEN"),
    "CP04": (0, 111, 0.0, 100.0, "GREEN"),
    "CP05": (1, 94, 1.1, 100.0, "GREEN"),
    "CS07": (3, 100, 3.0, 70.0, "RED"),
    "CS01": (0, 100, 0.0, 100.0, "GREEN"),
    "CS02": (1, 111, 0.9, 91.0, "RED"),
    "RI01": (1, 111, 0.9, 91.0, "RED"),
    "RI05": (6, 100, 6.0, 40.0, "RED"),
    "RI05S": (6, 111, 5.4, 46.0, "RED"),
    "TP01": (0, 94, 0.0, 100.0, "GREEN"),
    "BIZ01": (92, 92, 100.0, 100.0, "GREEN"),
    "BIZ02": (6, 100, 6.0, 40.0, "RED"),
    "BIZ03": (7, 113, 6.2, 58.0, "RED"),
}
RAISED = {"JI01", "JI02", "CS07", "CS02", "RI01", "RI05", "BIZ02", "BIZ03"}


@pytest.fixture(scope="module")
def kpis(freight):
    return scores.kpi_table(freight, RULES).cache()


def test_kpis_scores_and_status(kpis):
    rated = scores.with_status(scores.with_scores(kpis))
    found = {r.kpi_id: (r.num, r.den, r.value, r.score, r.status) for r in rated.collect()}
    assert found == GOLDEN


def test_rollups(kpis):
    pillars = {r.pillar: r.pillar_score for r in scores.pillar_scores(kpis, RULES).collect()}
    assert pillars == {
        "join_integrity": 97, "completeness": 100, "consistency": 99, "timeliness": 100, "referential": 97, "business": 66,
    }
    overall = scores.overall_score(kpis, RULES).first()
    assert (overall.overall_score, overall.n_kpis) == (85.0, 15)
    entities = {r.entity: r.entity_score for r in scores.entity_scores(kpis, ENTITIES).collect()}
    assert entities == {"order": 85.0, "order_shipment": 94.7, "shipment": 92.8}


def test_payload_is_one_nested_row(freight, kpis):
    tabulated = {name: (freight[t], c) for name, t, c in BREAKDOWNS}
    row = scores.payload(kpis, RULES, ENTITIES, tabulated).first()
    assert row.overall_score == 85.0
    assert row.entity_scores["order"] == 85.0
    assert row.pillar_scores["business"] == 66.0
    assert row.kpis["JI02"].num == 3
    assert [(b.label, b["count"]) for b in row.breakdowns["order_status"]] == [
        ("Shipped", 87), ("Planned", 8), ("Cancelled", 5),
    ]


def test_row_counts(freight):
    assert {r.table_name: r.n_rows for r in row_counts(freight).collect()} == {
        "order": 100, "order_shipment": 113, "shipment": 111,
    }


@pytest.mark.parametrize(
    "kpi_id,n", [("JI01", 6), ("JI02", 3), ("CS07", 3), ("CS02", 1), ("RI01", 1), ("RI05", 6), ("TP01", 0), ("BIZ01", 50),
                 ("BIZ02", 6), ("BIZ03", 7), ("CP01", 0), ("CP02", 0), ("CP05", 1), ("CS01", 0)],
)
def test_drilldown_counts(freight, kpi_id, n):
    rows = drilldown(freight, RULES, kpi_id.lower()).collect()
    assert len(rows) == n
    assert rows == drilldown(freight, RULES, kpi_id).collect()


def test_drilldown_details(freight):
    split = drilldown(freight, RULES, "CS07").first()
    assert split.asDict() == {
        "order_release_gid": "R-014", "order_status": "Shipped", "active_shipment_count": 2, "shipment_gid_sample": "S-014A",
    }
    on_time = drilldown(freight, RULES, "BIZ01")
    assert on_time.schema["actual_arrival"].dataType.simpleString() == "string"
    arrivals = [r.actual_arrival for r in on_time.collect()]
    assert arrivals == sorted(arrivals, reverse=True)


@pytest.mark.parametrize("kpi_id", ["JI03", "CP04", "RI05S", "NOPE"])
def test_no_drilldown(freight, kpi_id):
    with pytest.raises(KeyError):
        drilldown(freight, RULES, kpi_id)


def test_drilldown_agrees_with_count(freight, kpis):
    counts = {r.kpi_id: r.num for r in kpis.collect()}
    for kpi_id in ("JI02", "CS07", "CS02", "RI01", "RI05", "BIZ03", "CP05", "CS01"):
        assert failing_rows(freight, find_rule(RULES, kpi_id)).count() == counts[kpi_id]


def test_alerts_are_raised_once(spark, kpis):
    batch = alerts.candidates(kpis, RULES, wording.ALERT_TEXTS)
    none = sinks.empty_table(spark, schemas.DQ_ALERTS)
    now = F.lit("2025-07-20 09:00:00").cast("timestamp")
    first = alerts.raised(alerts.not_yet_raised(batch, none), none, now)
    rows = first.collect()
    assert {r.kpi_id for r in rows} == RAISED
    assert {r.kpi_id for r in rows if r.severity == "AMBER"} == {"JI01"}
    assert sorted(r.alert_id for r in rows) == list(range(1, 9))
    assert [(f.name, f.dataType) for f in first.schema] == [(f.name, f.dataType) for f in schemas.DQ_ALERTS]
    by_kpi = {r.kpi_id: r for r in rows}
    assert by_kpi["RI05"].message.startswith("For the Finance Analyst: ")
    assert alerts.not_yet_raised(batch, first).count() == 0


def test_alert_life_cycle(spark, kpis):
    batch = alerts.candidates(kpis, RULES, wording.ALERT_TEXTS)
    none = sinks.empty_table(spark, schemas.DQ_ALERTS)
    known = alerts.raised(batch, none, F.lit("2025-07-20 09:00:00").cast("timestamp"))
    reviewed = alerts.in_review(known, F.col("kpi_id") == "CS07", F.lit("ROOT CAUSE: x"))
    assert alerts.not_yet_raised(batch, reviewed).count() == 0
    assert [r.kpi_id for r in alerts.not_yet_raised(batch, reviewed, only_open=True).collect()] == ["CS07"]
    done = alerts.resolved(
        reviewed, F.col("kpi_id") == "CS07", F.lit("2025 | set stale"), F.lit("2025-07-21 10:00:00").cast("timestamp")
    )
    assert [r.kpi_id for r in alerts.not_yet_raised(batch, done).collect()] == ["CS07"]
    assert alerts.pending_alerts(done).first().severity == "RED"
    assert "CS07" not in {r.kpi_id for r in alerts.pending_alerts(done).collect()}
    assert [r.remediation_log for r in alerts.recent_fixes(done).collect()] == ["2025 | set stale"]
    assert alerts.cleared(done).count() == 0


def test_summary_names_worst_and_best(kpis):
    row = narrative.summary(kpis, RULES).first()
    assert (row.worst_kpi, row.best_kpi, row.overall_score) == ("RI05", "JI03", 85.0)
    assert "85%" in row.summary


def test_summary_sees_red_higher_is_better(spark):
    """A low on-time rate is the worst KPI although lower values are better elsewhere."""
    kpis = spark.createDataFrame(
        [("BIZ01", 10, 100, 10.0, 95.0, True), ("CP05", 7, 100, 3.5, 3.0, False)], schema=KPI_SCHEMA
    )
    row = narrative.summary(kpis, RULES).first()
    assert (row.worst_kpi, row.best_kpi) == ("BIZ01", None)


KPI_SCHEMA = "kpi_id string, num long, den long, value double, target_val double, higher_is_better boolean"


def test_rca_records(freight, kpis):
    samples = rootcause.evidence(freight, RULES)
    found = rootcause.rca_records(
        kpis.where("kpi_id IN ('JI02', 'CS07', 'JI01', 'CP01')"), RULES, wording.CAUSES, samples, F.lit("2025-07-20T09:00:00Z")
    )
    assert found.schema["record"].dataType.fieldNames() == schemas.RCA_RECORD.fieldNames()
    rows = {r.kpi_id: r for r in found.collect()}
    assert set(rows) == {"JI01", "JI02", "CS07"}
    assert rows["JI02"].affected_count == 3 and len(rows["JI02"].record.evidence) == 3
    assert '"os_id":"X-1"' in rows["JI02"].record.evidence[0]
    assert rows["JI01"].affected_count == 6
    assert rows["JI01"].record.rootCause == "KPI JI01 has 6 failing rows to look into."
    assert rows["CS07"].record.detectionDetails.severity == "RED"
    assert rows["CS07"].record.owner == "Data Engineer"


def test_fixes_move_their_kpi_and_nothing_else(freight):
    dry = {r.fix: (r.affected_rows, r.risk_level) for r in fixes.dry_run(freight, corrections.FREIGHT_FIXES).collect()}
    assert dry == {
        "CS07": (0, "LOW"), "JI02": (3, "HIGH"), "RI05": (6, "MEDIUM"), "BIZ03": (7, "MEDIUM"), "RI01": (1, "MEDIUM"),
        "CS02": (1, "MEDIUM"),
    }
    compared = {r.kpi_id: r for r in fixes.before_after(freight, RULES, [corrections.ZERO_WEIGHT]).collect()}
    assert {k for k, r in compared.items() if r.improved} == {"RI05", "BIZ02"}
    assert {k for k, r in compared.items() if r.num_before != r.num_after} == {"RI05", "BIZ02"}
    assert len(compared) == len(RULES)
    touched, others = fixes.touched_rules(RULES, [corrections.ZERO_WEIGHT])
    assert {r.kpi_id for r in others} == {"JI03", "CP02", "CP04", "CP05", "CS02", "RI01", "RI05S", "TP01", "BIZ01", "BIZ03"}
    everything = {r.kpi_id: r for r in fixes.before_after(freight, RULES, corrections.FREIGHT_FIXES).collect()}
    for kpi_id in ("JI02", "CS02", "RI01", "RI05", "BIZ02", "BIZ03"):
        assert everything[kpi_id].num_after == 0 and everything[kpi_id].status_after == "GREEN"
    # The re-assigned rows leave the active set: their orders are no longer matched.
    assert everything["JI01"].num_after == 87


def test_reversal_restores_the_rows(freight):
    undo = corrections.freight_reversals("S-042", "S-040", "2025-06-30")
    broken = [corrections.ZERO_WEIGHT, corrections.REASSIGNED]
    restored = fixes.apply_all(fixes.apply_all(freight, broken), [undo[2], undo[3]])
    for table in ("order", "order_shipment"):
        assert restored[table].exceptAll(freight[table]).count() == 0
        assert freight[table].exceptAll(restored[table]).count() == 0


def test_broad_reversal_activates_all_deleted_links(freight):
    """The literal undo of the stale fix is wider than the fix: every deleted link becomes active."""
    after = fixes.apply_all(freight, corrections.freight_reversals("S-042", "S-040", "2025-06-30")[:1])
    found = {r.kpi_id: r.num for r in scores.kpi_table(after, [find_rule(RULES, k) for k in ("JI01", "CS07")]).collect()}
    assert found == {"JI01": 100, "CS07": 10}


def test_capture_is_one_wide_row(kpis):
    row = capture(kpis, RULES, "Post-fix", F.lit("2025-07-20 09:00:00").cast("timestamp")).first()
    assert (row.overall_score, row.pillar_join, row.pillar_biz, row.ji02, row.biz03) == (85.0, 97.0, 66.0, 2.7, 6.2)
    assert row.label == "Post-fix"
