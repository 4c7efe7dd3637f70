"""One query per operator, over the whole warehouse tables: ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepulse.functions import text
from tablepulse.operators import alerts, fixes, history, narrative, rootcause, scores
from tablepulse.operators.derive import derive_shipments
from tablepulse.operators.drilldown import drilldown, failing_rows, failing_sample
from tablepulse.operators.joins import not_in
from tablepulse.operators.measure import row_counts
from tablepulse.operators.rules import catalogue, find_rule, rules_of_entity, with_rule
from tablepulse.operators.tagged import failing_keys
from tablepulse.operators.stored import Dated, StoredRates
from tablepulse.plans import corrections, warehouse, wording
from tablepulse.session import scratch_dir, state_dir
from tablepulse.sources import schemas, sinks
from tablepulse.sources.ledger import Ledger
from tablepulse.sources.tables import preview

Query = Callable[[SparkSession, str], DataFrame]

LINE_BUCKETS = 8  # for tables of some hundred MB; session.buckets proposes more for larger ones
CAPTURED_AT = "2024-02-01 09:00:00"
TOPICS = (("english", ("the", "and")), ("spanish", ("que", "el ")), ("french", ("le ", "ou")))
REPLY_TOPICS = (
    ("overall", ("the",)), ("ghost", ("que",)), ("orphan", ("der ",)), ("fix", ("el ",)), ("trend", ("ou", "un")),
)
TOKEN_PATTERN = "[0-9]{2,}"
PROPS = T.StructType([T.StructField("k", T.LongType(), True)])

# One query per KPI rule.
KPI_QUERIES = {
    "ji01_match_rate": "JI01",
    "ji02_orphan_rate": "JI02",
    "ji03_resolve_rate": "JI03",
    "cp01_null_rate": "CP01",
    "cp02_null_rate": "CP02",
    "cp04_any_null_rate": "CP04",
    "cp05_cond_null_rate": "CP05",
    "cs07_ambiguous_rate": "CS07",
    "cs01_sum_mismatch_rate": "CS01",
    "cs02_date_order_rate": "CS02",
    "ri01_domain_rate": "RI01",
    "ri05_range_rate": "RI05",
    "ri05s_range_rate": "RI05S",
    "tp01_late_rate": "TP01",
    "biz01_on_time_rate": "BIZ01",
    "biz02_range_rate": "BIZ02",
    "biz03_flag_rate": "BIZ03",
}
DRILLDOWNS = tuple(r.kpi_id for r in warehouse.RULES if r.drillable)
# Rules over dated rows: the table or view, the date that periods are taken from, and the tables behind them.
_DATED = tuple(
    Dated(view, date, tuple(find_rule(warehouse.RULES, k) for k in kpi_ids), *tables)
    for view, date, kpi_ids, *tables in (
        ("events", "ts", ("RI01",), "events"),
        ("dated_lines", "o_orderdate", ("CS02", "TP01", "BIZ01"), "orders", ("lineitem",)),
        ("lineitem", "l_shipdate", ("BIZ03",), "lineitem"),
    )
)


def _kpi(kpi_id: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rule = find_rule(warehouse.RULES, kpi_id)
        return scores.kpi_table(warehouse.load(spark, folder), [rule])

    return query


def _drilldown(kpi_id: str) -> Query:
    return lambda spark, folder: drilldown(warehouse.load(spark, folder), warehouse.RULES, kpi_id.lower())


def _breakdown(table: str, column: str) -> Query:
    return lambda spark, folder: scores.breakdown(warehouse.load(spark, folder)[table], column)


def _kpis(spark: SparkSession, folder: str) -> DataFrame:
    return scores.kpi_table(warehouse.load(spark, folder), warehouse.SCORED_RULES)


def kpi_table(spark, folder):
    return _kpis(spark, folder)


def kpi_report(spark, folder):
    """All rules, with those that are only reported."""
    return scores.kpi_table(warehouse.load(spark, folder), warehouse.RULES)


def kpi_scores(spark, folder):
    return scores.with_scores(_kpis(spark, folder)).select("kpi_id", "value", "target_val", "score")


def kpi_rag(spark, folder):
    return scores.with_status(_kpis(spark, folder)).select("kpi_id", "value", "target_val", "status")


def kpi_deviation(spark, folder):
    return scores.with_deviation(_kpis(spark, folder)).select(
        "kpi_id", "value", "target_val", F.round("deviation", 6).alias("deviation")
    )


def pillar_scores(spark, folder):
    return scores.pillar_scores(_kpis(spark, folder), warehouse.RULES)


def overall_score(spark, folder):
    return scores.overall_score(_kpis(spark, folder), warehouse.RULES)


def entity_scores(spark, folder):
    return scores.entity_scores(_kpis(spark, folder), warehouse.ENTITIES)


def entity_kpis(spark, folder):
    """The KPIs that concern one entity."""
    of_order = rules_of_entity(catalogue(spark, warehouse.RULES), "order").select("kpi_id", "name", "pillar")
    return _kpis(spark, folder).join(F.broadcast(of_order), "kpi_id").select("kpi_id", "name", "pillar", "value")


def kpi_payload(spark, folder):
    tables = warehouse.load(spark, folder)
    kpis = scores.kpi_table(tables, warehouse.SCORED_RULES)
    tabulated = {name: (tables[table], column) for name, table, column in warehouse.BREAKDOWNS}
    computed_at = F.expr(f"TIMESTAMP '{CAPTURED_AT} UTC'")
    nested = scores.payload(kpis, warehouse.RULES, warehouse.ENTITIES, tabulated, computed_at)
    keep_nulls = {"ignoreNullFields": "false"}
    as_json = [F.to_json(c, keep_nulls).alias(c) for c in ("counts", "pillar_scores", "entity_scores", "kpis", "breakdowns")]
    return nested.select("computed_at", "overall_score", *as_json)


def kpi_report_lines(spark, folder):
    kpis = scores.kpi_table(warehouse.load(spark, folder), warehouse.RULES)
    return scores.report(kpis, warehouse.RULES)


# What names a failing row of a KPI: its key, and a number where the key names several rows.
_LINE = ("l_orderkey", "l_linenumber")
ROW_KEYS = {
    "JI01": ("o_orderkey", "0"), "JI02": _LINE, "CP01": ("doc_id", "0"), "CP02": ("doc_id", "0"), "CP05": ("doc_id", "0"),
    "CS07": ("o_orderkey", "0"), "CS01": ("o_orderkey", "0"), "CS02": _LINE, "RI01": ("event_id", "0"),
    "RI05": ("c_custkey", "0"), "TP01": _LINE, "BIZ01": _LINE, "BIZ02": ("c_custkey", "0"), "BIZ03": _LINE,
}


def failing_samples(spark, folder):
    """Up to 20 failing rows of every KPI with a drill-down, and how many there are.

    One pass per table names the failing rows and the rules they break; ranks and totals are taken from that list.
    """
    tables, path = warehouse.load(spark, folder), scratch_dir(spark, "failing-keys")
    found = failing_keys(tables, [find_rule(warehouse.RULES, k) for k in DRILLDOWNS], ROW_KEYS)
    found.write.parquet(path)
    listed = spark.read.schema(found.schema).parquet(path)
    named = listed.select(F.explode("kpi_ids").alias("kpi_id"), "row_key", "row_no").where("kpi_id IS NOT NULL")
    return failing_sample(named, ["row_key", "row_no"])


# ---- history ----


def _monthly(spark: SparkSession, folder: str) -> DataFrame:
    """``captured_at, kpi_id, num, den, value, label`` per month and rule over dated rows, from stored counts."""
    paths = {name: f"{folder}/{name}.parquet" for name in warehouse.BASE_TABLES}
    store = StoredRates(spark, state_dir(spark, "rates", folder), paths, lambda narrowed: warehouse.load_files(spark, folder, narrowed), _DATED)
    return store.read().withColumn("label", F.when(F.col("value") >= 20, F.format_string("high %.1f", "value")))


def _overall(spark: SparkSession, folder: str) -> DataFrame:
    """The overall score of every month, ``captured_at, kpi_id, value``."""
    return history.overall_by_period(_monthly(spark, folder).select("captured_at", "kpi_id", "value"), warehouse.RULES)


def _captured_on(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.col("captured_at").cast("string").alias("captured_on"), *columns)


def history_listing(spark, folder):
    return _captured_on(history.listing(_monthly(spark, folder)), "kpi_id", "num", "den", "value", "label")


def history_delta(spark, folder):
    return _captured_on(history.with_delta(_monthly(spark, folder)), "kpi_id", "value", "delta")


def history_overall(spark, folder):
    return _captured_on(history.with_delta(_overall(spark, folder)), "value", "delta")


def history_trend(spark, folder):
    both = _monthly(spark, folder).select("captured_at", "kpi_id", "value").unionByName(_overall(spark, folder))
    return history.trend(both)


def history_without_label(spark, folder):
    return _captured_on(history.without_label(_monthly(spark, folder), "high 2"), "kpi_id", "value", "label")


def history_not_captured(spark, folder):
    """Events of other types in a second in which no purchase was recorded."""
    events = warehouse.load(spark, folder)["events"].withColumnRenamed("ts", "captured_at")
    batch, seen = events.where("event_type <> 'purchase'"), events.where("event_type = 'purchase'")
    return history.not_yet_captured(batch, seen).select("event_id", "event_type")


def snapshot_wide(spark, folder):
    wide = history.capture(_kpis(spark, folder), warehouse.RULES, "Nightly", F.lit(CAPTURED_AT).cast("timestamp_ntz"))
    return wide.withColumn("captured_at", F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss"))


def snapshot_long(spark, folder):
    wide = history.capture(_kpis(spark, folder), warehouse.RULES, None, F.lit(CAPTURED_AT).cast("timestamp_ntz"))
    return history.to_long(wide).select("kpi_id", "value")


# ---- alerts ----


def _alert_table(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse.alert_table(warehouse.load(spark, folder)["events"])


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    return alerts.candidates(_kpis(spark, folder), warehouse.RULES, wording.ALERT_TEXTS)


def alerts_candidates(spark, folder):
    return _candidates(spark, folder).drop("ordinal")


def alerts_new(spark, folder):
    fresh = alerts.not_yet_raised(_candidates(spark, folder), _alert_table(spark, folder))
    return fresh.select("kpi_id", "kpi_value", "target_value", "severity", "owner")


def alerts_new_only_open(spark, folder):
    """Only alerts in status Open block a new one; those of KPI CS07 are all under review or done."""
    known = alerts.in_review(_alert_table(spark, folder), F.col("kpi_id") == "CS07", F.col("message"))
    fresh = alerts.not_yet_raised(_candidates(spark, folder), known, only_open=True)
    return fresh.select("kpi_id", "kpi_value", "target_value", "severity", "owner")


def alerts_raised(spark, folder):
    known = _alert_table(spark, folder)
    fresh = alerts.not_yet_raised(_candidates(spark, folder), known)
    full = alerts.raised(fresh, known, F.lit(CAPTURED_AT).cast("timestamp"))
    return full.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).drop(
        "remediation_log", "resolved_at"
    )


def alerts_ranked(spark, folder):
    return alerts.pending_alerts(_alert_table(spark, folder)).select(
        "alert_id", "kpi_id", "kpi_value", "severity", "status", "severity_rank"
    )


def alerts_by_owner(spark, folder):
    owned = with_rule(alerts.pending_alerts(_alert_table(spark, folder)), warehouse.RULES, "owner")
    return owned.groupBy("owner", "kpi_id", "severity").agg(F.count(F.lit(1)).alias("n_alerts"))


def _alert_ledger(spark: SparkSession, folder: str) -> Ledger:
    """The alerts as a table of which only changed rows are written."""
    known = _alert_table(spark, folder)
    return Ledger(spark, scratch_dir(spark, "alert-changes"), known.schema, ["alert_id"], known)


def alerts_in_review(spark, folder):
    """The alerts after some were put under review: changed rows, written apart, laid over the rest."""
    which = (F.col("kpi_id") == "RI01") & (F.col("status") == alerts.OPEN)
    explained = F.concat(F.lit("ROOT CAUSE: "), F.col("message"))
    table = _alert_ledger(spark, folder)
    table.update(which, lambda rows: alerts.in_review(rows, which, explained))
    return table.read().select("alert_id", "kpi_id", "message", "status")


def alerts_resolved(spark, folder):
    """The alerts after some were closed: changed rows, written apart, laid over the rest."""
    which = (F.col("kpi_id") == "RI05") & (F.col("status") != alerts.RESOLVED)
    log = F.concat(F.lit(f"{CAPTURED_AT} | set to NULL | alert "), F.col("alert_id").cast("string"))
    table = _alert_ledger(spark, folder)
    table.update(which, lambda rows: alerts.resolved(rows, which, log, F.lit(CAPTURED_AT).cast("timestamp_ntz")))
    return table.read().select(
        "alert_id", "status", "remediation_log",
        F.date_format("resolved_at", "yyyy-MM-dd HH:mm:ss").alias("resolved_at"),
    )


def alerts_recent_fixes(spark, folder):
    return alerts.recent_fixes(_alert_table(spark, folder)).withColumn(
        "resolved_at", F.date_format("resolved_at", "yyyy-MM-dd HH:mm:ss")
    )


def rca_records(spark, folder):
    tables = warehouse.load(spark, folder)
    kpis = scores.kpi_table(tables, warehouse.SCORED_RULES)
    sampled = tuple(r for r in warehouse.SCORED_RULES if r.drillable)
    found = rootcause.rca_records(
        kpis, warehouse.RULES, wording.CAUSES, rootcause.evidence(tables, sampled), F.lit(CAPTURED_AT)
    )
    r = "record."
    return found.select(
        "kpi_id",
        "affected_count",
        F.col(r + "issueSummary").alias("issue_summary"),
        F.col(r + "detectionDetails.dataset").alias("dataset"),
        F.col(r + "detectionDetails.ruleViolated").alias("rule_violated"),
        F.col(r + "detectionDetails.severity").alias("severity"),
        F.col(r + "rootCause").alias("root_cause"),
        F.size(r + "evidence").cast("long").alias("n_evidence"),
        F.get(F.col(r + "evidence"), F.lit(0)).alias("first_evidence"),
        F.col(r + "correctiveAction").alias("corrective_action"),
        F.col(r + "owner").alias("owner"),
        F.col(r + "status").alias("status"),
    )


# ---- corrections ----


def _lines(lineitem: DataFrame) -> DataFrame:
    """Whole lines, with the date as text."""
    return lineitem.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))


def fix_stale_links(spark, folder):
    return _lines(fixes.apply(warehouse.load(spark, folder), corrections.WAREHOUSE_STALE))


def fix_stale_links_undone(spark, folder):
    both = (corrections.WAREHOUSE_STALE, corrections.WAREHOUSE_STALE_UNDONE)
    return _lines(fixes.apply_all(warehouse.load(spark, folder), both)["lineitem"])


def fix_orphans(spark, folder):
    return _lines(fixes.apply(warehouse.load(spark, folder), corrections.WAREHOUSE_ORPHANS))


def fix_delete(spark, folder):
    """Delete by condition; rows for which it is NULL stay."""
    known = {"dq_alerts": _alert_table(spark, folder)}
    kept = fixes.apply(known, fixes.Delete("resolved", "dq_alerts", "status = 'Resolved'"))
    return kept.select("alert_id", "status")


def fix_zero_amounts(spark, folder):
    return fixes.apply(warehouse.load(spark, folder), corrections.WAREHOUSE_NO_CREDIT)


def fix_zero_amounts_undone(spark, folder):
    both = (corrections.WAREHOUSE_NO_CREDIT, corrections.WAREHOUSE_NO_CREDIT_UNDONE)
    return fixes.apply_all(warehouse.load(spark, folder), both)["customer"]


def fix_reassigned(spark, folder):
    return _lines(fixes.apply(warehouse.load(spark, folder), corrections.WAREHOUSE_RETURNED))


def fix_reassigned_undone(spark, folder):
    both = (corrections.WAREHOUSE_RETURNED, corrections.WAREHOUSE_RETURNED_UNDONE)
    return _lines(fixes.apply_all(warehouse.load(spark, folder), both)["lineitem"])


def _events(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def fix_status_words(spark, folder):
    return _events(fixes.apply(warehouse.load(spark, folder), corrections.WAREHOUSE_EVENT_TYPES))


def fix_status_words_undone(spark, folder):
    both = (corrections.WAREHOUSE_EVENT_TYPES, corrections.WAREHOUSE_EVENT_TYPES_UNDONE)
    return _events(fixes.apply_all(warehouse.load(spark, folder), both)["events"])


def _dated(lines: DataFrame) -> DataFrame:
    """Whole lines with the date of their order."""
    dated = _lines(lines.select(*schemas.WAREHOUSE["lineitem"].names, "o_orderdate"))
    return dated.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


def fix_date_order(spark, folder):
    return _dated(fixes.apply(warehouse.load(spark, folder), corrections.WAREHOUSE_DATES))


def fix_date_order_undone(spark, folder):
    both = (corrections.WAREHOUSE_DATES, corrections.WAREHOUSE_DATES_UNDONE)
    return _dated(fixes.apply_all(warehouse.load(spark, folder), both)["dated_lines"])


def alerts_cleared(spark, folder):
    """Every alert with an id goes. Alerts that never were amber or red were given none, and stay."""
    known = _alert_table(spark, folder).withColumn("alert_id", F.when(F.col("severity") != "GREEN", F.col("alert_id")))
    return alerts.cleared(known).select("kpi_id", "severity", "status", "message")


def fix_dry_run(spark, folder):
    planned = (*corrections.WAREHOUSE_FIXES, corrections.WAREHOUSE_STALE)
    return fixes.dry_run(warehouse.load(spark, folder), planned)


def fix_before_after(spark, folder):
    return fixes.before_after(
        warehouse.load(spark, folder),
        warehouse.SCORED_RULES,
        corrections.WAREHOUSE_FIXES,
        warehouse.bind,
        views=["dated_lines"],
    )


def derived_shipments(spark, folder):
    tables = warehouse.load(spark, folder)
    derived = derive_shipments(
        warehouse.freight_links(tables["lineitem"]),
        warehouse.freight_orders(tables["orders"]),
        warehouse.freight_shipments(tables["lineitem"]),
    )
    dates = ("planned_pickup", "planned_delivery", "actual_departure", "actual_arrival")
    return derived.withColumns({d: F.col(d).cast("string") for d in dates}).withColumn(
        "weight_kg", F.col("weight_kg").cast("double")
    )


def unlabelled_documents(spark, folder):
    """Documents whose id is NOT IN the labels."""
    tables = warehouse.load(spark, folder)
    return not_in(tables["documents"], "doc_id", tables["labels"], "doc_id").select("doc_id", "lang")


def unlabelled_if_certain(spark, folder):
    """NOT IN against ids of which some are NULL: nothing is certain, so nothing comes back."""
    tables = warehouse.load(spark, folder)
    graded = tables["labels"].select(F.when(F.col("quality") == 1, F.col("doc_id")).alias("doc_id"))
    return not_in(tables["documents"], "doc_id", graded, "doc_id").select("doc_id", "lang")


# ---- texts ----


def screen_statements(spark, folder):
    proposed = warehouse.statement_table(warehouse.load(spark, folder)["events"])
    return proposed.withColumn("screened", text.screen_statement(F.col("statement"))).select(
        "event_id", "screened.is_safe", "screened.reason"
    )


def extract_tokens(spark, folder):
    documents = warehouse.load(spark, folder)["documents"]
    found = documents.select("doc_id", text.tokens(F.col("text"), TOKEN_PATTERN).alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", ",").alias("tokens"))


def cited_kpis(spark, folder):
    replies = warehouse.reply_table(warehouse.load(spark, folder)["events"])
    return replies.select("event_id", F.array_join(text.cited_kpis(F.col("reply"), [r.kpi_id for r in warehouse.RULES]), ",").alias("cited"))


def route_messages(spark, folder):
    turns = warehouse.load(spark, folder)["conversations"]
    return turns.select("conv_id", "turn", text.route(F.col("text"), TOPICS, "other").alias("topic"))


def chat_replies(spark, folder):
    tables = warehouse.load(spark, folder)
    answered = narrative.replies(
        tables["conversations"], _kpis(spark, folder), warehouse.RULES, _overall(spark, folder), REPLY_TOPICS
    )
    return answered.select("conv_id", "turn", "topic", "reply")


def parse_json(spark, folder):
    answers = warehouse.answer_table(warehouse.load(spark, folder)["events"])
    parsed = answers.withColumn("p", text.parse_json(F.col("answer"), PROPS))
    return parsed.select("event_id", F.col("p.parsed.k").alias("k"), F.col("p.error").alias("error"))


def conversation_tail(spark, folder):
    return narrative.conversation_tail(warehouse.load(spark, folder)["conversations"])


def summary_text(spark, folder):
    return narrative.summary(_kpis(spark, folder), warehouse.RULES)


def compact_context(spark, folder):
    """What an answer may rest on: KPIs, captures, pillars, and the alerts that are still open."""
    monthly = _overall(spark, folder).select(F.col("captured_at").cast("string").alias("label"), F.col("value").alias("overall_score"))
    open_alerts = alerts.pending_alerts(_alert_table(spark, folder))
    return narrative.compact_context(_kpis(spark, folder), monthly, warehouse.RULES, open_alerts)


# ---- sources and sinks ----


def table_counts(spark, folder):
    tables = warehouse.load(spark, folder)
    others = {name: spark.read.schema(column).parquet(f"{folder}/{name}.parquet") for name, column in warehouse.OTHER_TABLES.items()}
    return row_counts({**{name: tables[name] for name in warehouse.BASE_TABLES}, **others})


def preview_orders(spark, folder):
    rows = preview(warehouse.load(spark, folder)["orders"], ["o_orderkey"])
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def load_report(spark, folder):
    """Lines loaded anew, and what was loaded, counted while it was written."""
    lineitem = warehouse.load(spark, folder)["lineitem"]
    report = sinks.counted_load(lineitem, scratch_dir(spark, "loaded-lines"), "l_returnflag", warehouse.RETURN_FLAGS)
    return report.withColumnRenamed("label", "l_returnflag")


def scan_report(spark, folder):
    """The same report on rows that are there already, by one scan."""
    return sinks.load_report(warehouse.load(spark, folder)["lineitem"], "l_returnflag").withColumnRenamed("label", "l_returnflag")


def export_failing_rows(spark, folder):
    """Failing customers written as CSV and read back."""
    path = scratch_dir(spark, "failing-rows")
    failing = failing_rows(warehouse.load(spark, folder), find_rule(warehouse.RULES, "RI05"))
    sinks.export_csv(failing, path)
    return spark.read.schema(failing.schema).option("header", True).csv(path)


def reload_and_append(spark, folder):
    """A table of customers: loaded twice with overwrite, then appended to once."""
    path = scratch_dir(spark, "customers")
    customers = warehouse.load(spark, folder)["customer"].select("c_custkey", "c_acctbal")
    sinks.create_if_absent(spark, path, customers.schema)
    sinks.reload(customers.where("c_acctbal > 0"), path)
    sinks.reload(customers.where("c_acctbal > 100"), path)
    sinks.append(customers.where("c_acctbal <= 0"), path)
    return spark.read.schema(customers.schema).parquet(path)


def bucketed_line_rates(spark, folder):
    """The rules over lines with their order's date, counted over tables kept in buckets by order key."""
    root = scratch_dir(spark, "buckets")
    tables = warehouse.bucketed(warehouse.load(spark, folder), LINE_BUCKETS, root, f"buckets_{uuid.uuid4().hex}")
    return scores.kpi_table(tables, [r for r in warehouse.RULES if r.kpi_id in ("CS02", "TP01", "BIZ01")]).select("kpi_id", "num", "den", "value")


def latest_version(spark, folder):
    """Alerts kept as versions: all of them, then without the resolved ones."""
    root = scratch_dir(spark, "alerts")
    known = _alert_table(spark, folder).select("alert_id", "kpi_id", "status")
    sinks.write_version(known, root)
    first = sinks.read_version(spark, root, known.schema)
    sinks.write_version(first.where("status <> 'Resolved'"), root)
    return sinks.read_version(spark, root, known.schema)


def derived_appended(spark, folder):
    """Shipments that exist, with the derived ones appended beside them, read back from the table."""
    path = scratch_dir(spark, "shipments")
    derived = derived_shipments(spark, folder).select("shipment_gid", "status", "dq_flag")
    present = warehouse.freight_shipments(warehouse.load(spark, folder)["lineitem"])
    sinks.append(present.select("shipment_gid", F.lit("Present").alias("status"), F.lit("OK").alias("dq_flag")), path)
    sinks.append(derived, path)
    return spark.read.schema(derived.schema).parquet(path)


def captures_appended(spark, folder):
    """Monthly captures appended to a table: half of them, then all of them twice; every month is there once."""
    path = scratch_dir(spark, "captures")
    months = _overall(spark, folder).where("captured_at IS NOT NULL").select(
        F.col("captured_at").cast("timestamp").alias("captured_at"), F.lit("seed").alias("label"), F.col("value").alias("overall_score")
    )
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schemas.KPI_SNAPSHOTS.fields if f.name not in (*months.columns, "snapshot_id")}
    batch = months.withColumns(missing)
    table = Ledger(spark, path, schemas.KPI_SNAPSHOTS)
    for rows in (batch.where("month(captured_at) <= 6"), batch, batch):
        table.append_made(lambda known, next_id, rows=rows: history.appended(rows, known, next_id - 1))
    return table.read().select(F.date_format("captured_at", "yyyy-MM-dd").alias("captured_on"), "overall_score", "label")


QUERIES: dict[str, Query] = {
    **{name: _kpi(kpi_id) for name, kpi_id in KPI_QUERIES.items()},
    "kpi_table": kpi_table,
    "kpi_report": kpi_report,
    "kpi_scores": kpi_scores,
    "kpi_rag": kpi_rag,
    "kpi_deviation": kpi_deviation,
    "pillar_scores": pillar_scores,
    "overall_score": overall_score,
    "entity_scores": entity_scores,
    "entity_kpis": entity_kpis,
    "kpi_payload": kpi_payload,
    "kpi_report_lines": kpi_report_lines,
    **{f"breakdown_{name}": _breakdown(table, column) for name, table, column in warehouse.BREAKDOWNS},
    **{f"drilldown_{kpi_id.lower()}": _drilldown(kpi_id) for kpi_id in DRILLDOWNS},
    "failing_samples": failing_samples,
    "history": history_listing,
    "history_delta": history_delta,
    "history_overall": history_overall,
    "history_trend": history_trend,
    "history_without_label": history_without_label,
    "history_not_captured": history_not_captured,
    "snapshot_wide": snapshot_wide,
    "snapshot_long": snapshot_long,
    "alerts_candidates": alerts_candidates,
    "alerts_new": alerts_new,
    "alerts_new_only_open": alerts_new_only_open,
    "alerts_raised": alerts_raised,
    "alerts_ranked": alerts_ranked,
    "alerts_by_owner": alerts_by_owner,
    "alerts_in_review": alerts_in_review,
    "alerts_resolved": alerts_resolved,
    "alerts_recent_fixes": alerts_recent_fixes,
    "rca_records": rca_records,
    "fix_stale_links": fix_stale_links,
    "fix_stale_links_undone": fix_stale_links_undone,
    "fix_orphans": fix_orphans,
    "fix_delete": fix_delete,
    "fix_zero_amounts": fix_zero_amounts,
    "fix_zero_amounts_undone": fix_zero_amounts_undone,
    "fix_reassigned": fix_reassigned,
    "fix_reassigned_undone": fix_reassigned_undone,
    "fix_status_words": fix_status_words,
    "fix_status_words_undone": fix_status_words_undone,
    "fix_date_order": fix_date_order,
    "fix_date_order_undone": fix_date_order_undone,
    "alerts_cleared": alerts_cleared,
    "fix_dry_run": fix_dry_run,
    "fix_before_after": fix_before_after,
    "derive_shipments": derived_shipments,
    "unlabelled_documents": unlabelled_documents,
    "unlabelled_if_certain": unlabelled_if_certain,
    "screen_statements": screen_statements,
    "extract_tokens": extract_tokens,
    "cited_kpis": cited_kpis,
    "route_messages": route_messages,
    "chat_replies": chat_replies,
    "parse_json": parse_json,
    "conversation_tail": conversation_tail,
    "summary_text": summary_text,
    "compact_context": compact_context,
    "table_counts": table_counts,
    "preview_orders": preview_orders,
    "load_report": load_report,
    "scan_report": scan_report,
    "export_failing_rows": export_failing_rows,
    "reload_and_append": reload_and_append,
    "bucketed_line_rates": bucketed_line_rates,
    "latest_version": latest_version,
    "derived_appended": derived_appended,
    "captures_appended": captures_appended,
}
