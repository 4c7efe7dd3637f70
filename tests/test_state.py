"""Tables that change: history, sinks, and the whole cycle from detection to verification."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablepulse.operators import alerts, history
from tablepulse.plans import corrections, cycle, wording
from tablepulse.plans.freight import RULES
from tablepulse.session import scratch_dir
from tablepulse.sources import schemas, sinks
from tablepulse.sources.tables import catalog_tables, preview

SCORES = (93, 91, 90, 89, 88, 87, 86, 85)


def captures(spark):
    """Eight weekly captures with a falling score; business KPIs are not known yet."""
    rows = [
        {
            "captured_at": dt.datetime(2025, 6, 14, 9, 0, 0, tzinfo=dt.timezone.utc) + dt.timedelta(days=5 * i),
            "label": None if i == 3 else f"Day {i}",
            "overall_score": float(s),
            "ji02": round(0.4 * i, 1),
        }
        for i, s in enumerate(SCORES)
    ]
    return sinks.literal_batch(spark, rows, schemas.KPI_SNAPSHOTS).drop("snapshot_id")


def test_seeding_twice_adds_nothing(spark):
    empty = sinks.empty_table(spark, schemas.KPI_SNAPSHOTS)
    first = history.appended(captures(spark), empty)
    assert [r.snapshot_id for r in first.orderBy("captured_at").collect()] == list(range(1, 9))
    later = captures(spark).withColumn("captured_at", F.col("captured_at") + F.expr("INTERVAL 200 MILLISECONDS"))
    assert history.appended(later, first).count() == 0
    assert history.appended(captures(spark), empty).count() == 8


def test_history_listing_and_delta(spark):
    first = history.appended(captures(spark), sinks.empty_table(spark, schemas.KPI_SNAPSHOTS))
    listed = history.listing(first).collect()
    assert [r.overall_score for r in listed] == list(map(float, SCORES))
    assert listed[3].label == ""
    long = history.to_long(first, ["overall_score", "ji02"])
    deltas = {(r.kpi_id, r.value): r.delta for r in history.with_delta(long).collect()}
    assert deltas[("overall_score", 93.0)] is None
    assert deltas[("overall_score", 85.0)] == -1.0
    assert deltas[("ji02", 0.4)] == 0.4
    told = {r.kpi_id: r.sentence for r in history.trend(long).collect()}
    assert told["overall_score"] == "Over 8 captures it declined from 93.0% to 85.0%."
    one = long.where("captured_at < '2025-06-15'")
    assert {r.sentence for r in history.trend(one).collect()} == {"No trend yet."}


def test_post_fix_captures_can_be_dropped(spark):
    rows = captures(spark).withColumn("label", F.when(F.col("overall_score") < 87, "Post-fix 1").otherwise(F.col("label")))
    assert history.without_label(rows, "Post-fix").count() == 6


def test_create_append_reload(spark):
    path = scratch_dir(spark, "alerts")
    sinks.create_if_absent(spark, path, schemas.DQ_ALERTS)
    assert spark.read.parquet(path).schema == schemas.DQ_ALERTS
    row = sinks.literal_batch(spark, [{"alert_id": 1, "kpi_id": "CS07", "status": "Open"}], schemas.DQ_ALERTS)
    sinks.append(row, path)
    sinks.append(row, path)
    sinks.create_if_absent(spark, path, schemas.DQ_ALERTS)
    assert spark.read.schema(schemas.DQ_ALERTS).parquet(path).count() == 2
    sinks.reload(row, path)
    assert spark.read.schema(schemas.DQ_ALERTS).parquet(path).count() == 1


def test_catalog_tables(spark):
    try:
        sinks.create_tables(spark, "freight_test", {"order": schemas.ORDER})
        sinks.create_tables(spark, "freight_test", {"order": schemas.ORDER})
        batch = sinks.literal_batch(spark, [{"order_release_gid": "a", "total_weight_kg": 1.0}], schemas.ORDER)
        sinks.insert_into(batch, "freight_test", "order")
        stored = catalog_tables(spark, "freight_test", ["order"])["order"]
        assert [r.order_release_gid for r in preview(stored, ["order_release_gid"]).collect()] == ["a"]
        assert [(f.name, f.dataType) for f in stored.schema] == [(f.name, f.dataType) for f in schemas.ORDER]
    finally:
        spark.sql("DROP SCHEMA IF EXISTS freight_test CASCADE")


def test_versions(spark, freight):
    root = scratch_dir(spark, "orders")
    assert sinks.read_version(spark, root, schemas.ORDER).count() == 0
    assert sinks.write_version(freight["order"], root) == 1
    first = sinks.read_version(spark, root, schemas.ORDER)
    assert sinks.write_version(first.where("order_status = 'Shipped'"), root) == 2
    assert sinks.versions(spark, root) == [1, 2]
    assert sinks.read_version(spark, root, schemas.ORDER).count() == 87
    assert sinks.read_version(spark, root, schemas.ORDER, 1).count() == 100


def test_csv_export_has_a_header(spark, freight):
    path = scratch_dir(spark, "csv")
    sinks.export_csv(freight["order"].where("total_weight_kg <= 0").coalesce(1), path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines[0].startswith("order_release_gid,order_date") and len(lines) == 7


def test_load_report(freight):
    report = sinks.load_report(freight["order_shipment"], "dq_flag").collect()
    assert [(r.label, r.n, r.total_rows) for r in report][:3] == [("OK", 78, 113), ("Ghost Stale Delete", 9, 113), ("Re-assigned", 7, 113)]


def test_whole_cycle(spark, freight):
    at = F.lit("2025-07-20 09:00:00").cast("timestamp")
    none = sinks.empty_table(spark, schemas.DQ_ALERTS)
    known = cycle.detect(freight, RULES, wording.ALERT_TEXTS, none, at).cache()
    assert known.count() == 8
    assert cycle.detect(freight, RULES, wording.ALERT_TEXTS, known, at).count() == 0
    explained = cycle.explain(freight, RULES, wording.CAUSES, known, "RI05", at).cache()
    ri05 = explained.where("kpi_id = 'RI05'").first()
    assert ri05.status == alerts.IN_REVIEW and ri05.message.startswith("ROOT CAUSE: Test or placeholder")
    assert '"order_release_gid":"R-017"' in ri05.message
    assert explained.where("status = 'Open'").count() == 7

    plan = cycle.remediate(freight, RULES, corrections.ZERO_WEIGHT, explained, ri05.alert_id, "cleared", at)
    assert plan.plan.first().affected_rows == 6 and plan.tables is freight and plan.capture is None
    done = cycle.remediate(freight, RULES, corrections.ZERO_WEIGHT, explained, ri05.alert_id, "cleared", at, approved=True)
    closed = done.alerts.where(F.col("alert_id") == ri05.alert_id).first()
    assert closed.status == alerts.RESOLVED and closed.remediation_log.endswith("RI05 on order | cleared")
    capture = done.capture.first()
    assert (capture.label, capture.ri05, capture.biz02) == ("Post-fix", 0.0, 0.0) and capture.overall_score > 85
    assert {r.kpi_id for r in done.compared.where("improved").collect()} == {"RI05", "BIZ02"}


def test_numbering_in_groups_follows_the_order(spark):
    existing = spark.createDataFrame([(41,)], "id long")
    batch = spark.range(0, 500, 1, 8).select(
        (F.col("id") * 37 % 500).alias("n"), F.expr("timestamp '2025-01-01 00:00:00' + make_interval(0, 0, 0, 0, id * 37 % 500)").alias("at")
    )
    found = history.numbered_by(batch, existing, "id", F.to_date("at"), ["at"]).orderBy("at").collect()
    assert [r.id for r in found] == list(range(42, 542)) and [r.n for r in found] == list(range(500))
    assert history.numbered_by(batch.where("false"), existing, "id", F.to_date("at"), ["at"]).count() == 0


def test_large_batches_are_not_numbered_by_one_task(spark, monkeypatch):
    monkeypatch.setattr(history, "MAX_BATCH", 3)
    numbered = history.with_next_ids(spark.range(4).withColumnRenamed("id", "n"), spark.range(0), "id", ["n"])
    with pytest.raises(Exception, match="too many rows"):
        numbered.collect()


def test_versions_are_never_overwritten(spark):
    root = scratch_dir(spark, "versions")
    first = spark.range(3)
    assert sinks.write_version(first, root) == 1
    # Another writer has begun the next version and not finished it.
    spark.range(1).write.parquet(f"{root}/v=2")
    fs_path, fs = sinks.file_system(spark, f"{root}/v=2/_SUCCESS")
    fs.delete(fs_path, False)
    assert sinks.write_version(spark.range(5), root) == 3
    assert sinks.versions(spark, root) == [1, 3]
    assert sinks.read_version(spark, root, first.schema).count() == 5
    sinks.append_to_latest(spark.range(2), root)
    assert sinks.versions(spark, root) == [1, 3]
    assert sinks.read_version(spark, root, first.schema).count() == 7


def test_payload_lists_are_bounded(spark):
    from tablepulse.operators.scores import breakdown_lists

    many = spark.range(300).selectExpr("CAST(id % 100 AS STRING) AS a", "CASE WHEN id % 3 = 0 THEN 'x' END AS b")
    rows = {r.name: r.rows for r in breakdown_lists({"a": (many, "a"), "b": (many, "b")}).collect()}
    assert len(rows["a"]) == 50 and all(x["count"] == 3 for x in rows["a"])
    assert [(x.label, x["count"]) for x in rows["b"]] == [(None, 200), ("x", 100)]


def test_a_load_is_counted_while_it_is_written(spark, freight):
    path = scratch_dir(spark, "counted")
    known = ("OK", "Ghost Stale Delete", "Re-assigned")
    report = sinks.counted_load(freight["order_shipment"], path, "dq_flag", known).collect()
    assert [(r.label, r.n, r.total_rows) for r in report] == [("OK", 78, 113), ("(other)", 19, 113), ("Ghost Stale Delete", 9, 113), ("Re-assigned", 7, 113)]
    assert spark.read.parquet(path).count() == 113
    nulls = freight["order_shipment"].withColumn("dq_flag", F.when(F.col("dq_flag") == "OK", F.col("dq_flag")))
    assert {(r.label, r.n) for r in sinks.counted_load(nulls, path, "dq_flag", known).collect()} == {("OK", 78), (None, 35)}
    assert sinks.counted_load(freight["order_shipment"].where("false"), path, "dq_flag", known).collect() == []
    plan = sinks.counted_load(freight["order_shipment"], path, "dq_flag", known)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "InMemory" not in plan, "the report reads no table"


def test_a_small_batch_reads_its_own_period_of_the_history(spark):
    path = scratch_dir(spark, "long-history")
    at = F.expr("timestamp '2025-01-01 00:00:00' + make_interval(0, 0, 0, id % 40, 0, 0, id)").alias("captured_at")
    long = spark.range(4000).select(at).withColumn("captured_on", F.to_date("captured_at"))
    long.repartition("captured_on").write.partitionBy("captured_on").parquet(path)
    # What is no Parquet file breaks every scan that opens it.
    broken, fs = sinks.file_system(spark, f"{path}/captured_on=2025-01-09/broken.parquet")
    stream = fs.create(broken, False)
    stream.write(b"no parquet file at all")
    stream.close()
    stored = spark.read.schema("captured_at timestamp, captured_on date").parquet(path)
    batch = spark.sql("SELECT explode(array(timestamp '2025-01-03 00:00:02', timestamp '2025-01-03 00:00:03')) AS captured_at")
    with pytest.raises(Exception, match="broken.parquet|not a Parquet"):
        history.not_yet_captured(batch, stored).collect()
    assert [str(r.captured_at) for r in history.not_yet_captured(batch, stored, bounded=True).collect()] == ["2025-01-03 00:00:03"]
