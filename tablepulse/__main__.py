"""Run the freight checks over tables kept as versions below one folder.

    python -m tablepulse --root /shared/freight init
    python -m tablepulse --root /shared/freight load order --from /landing/order
    python -m tablepulse --root /shared/freight kpis

Every command prints JSON lines. Commands that change a base table write its next version; alerts and captures are
ledgers, so several commands may add and change them at once, and a changed alert is written alone.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepulse.operators import alerts, fixes, history, narrative, scores
from tablepulse.operators.drilldown import drilldown
from tablepulse.operators.rules import Tables
from tablepulse.plans import corrections, cycle, freight, wording
from tablepulse.sources import schemas, sinks
from tablepulse.sources.ledger import Ledger
from tablepulse.sources.tables import TableSet

BASE = ("order", "order_shipment", "shipment")
STATE_KEYS = {"kpi_snapshots": ("snapshot_id",), "dq_alerts": ("alert_id",)}


def ledger(spark: SparkSession, root: str, name: str) -> Ledger:
    return Ledger(spark, f"{root}/{name}", schemas.TABLES[name], STATE_KEYS[name])


def open_tables(spark: SparkSession, root: str) -> TableSet:
    """The latest state of every table; empty ones where nothing was written yet."""
    openers = {n: lambda _, n=n: sinks.read_version(spark, f"{root}/{n}", schemas.TABLES[n]) for n in BASE}
    return TableSet({**openers, **{n: lambda _, n=n: ledger(spark, root, n).read() for n in STATE_KEYS}})


def emit(df: DataFrame) -> None:
    for row in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line")).toLocalIterator():
        print(row.line)


def kpi_table(tables: Tables) -> DataFrame:
    return scores.kpi_table(tables, freight.SCORED_RULES)


def write_all(before: Tables, after: Tables, root: str, names: Sequence[str]) -> None:
    for name in names:
        if after[name] is not before[name]:
            sinks.write_version(after[name], f"{root}/{name}")


def add_capture(capture: DataFrame, table: Ledger) -> None:
    table.append_made(lambda known, next_id: history.appended(capture, known, next_id - 1))


def fix_for(kpi_id: str) -> fixes.Fix:
    wanted = {"BIZ02": "RI05"}.get(kpi_id.upper(), kpi_id.upper())
    for fix in corrections.FREIGHT_FIXES:
        if fix.name == wanted:
            return fix
    raise KeyError(f"no correction for KPI '{kpi_id}'")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tablepulse", description=__doc__.splitlines()[0])
    p.add_argument("--root", required=True, help="folder of the tables, shared by all executors")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init", "kpis", "report", "history", "alerts", "monitor", "summary", "recent-fixes"):
        sub.add_parser(name)
    load = sub.add_parser("load")
    load.add_argument("table", choices=sorted(schemas.TABLES))
    load.add_argument("--from", dest="source", required=True, help="parquet folder")
    sub.add_parser("drilldown").add_argument("kpi")
    sub.add_parser("rootcause").add_argument("kpi")
    sub.add_parser("snapshot").add_argument("--label", default=cycle.POST_FIX)
    sub.add_parser("chat").add_argument("message")
    remediate = sub.add_parser("remediate")
    remediate.add_argument("kpi")
    remediate.add_argument("--alert", type=int, help="the alert to close; needed with --approve")
    remediate.add_argument("--approve", action="store_true")
    remediate.add_argument("--explanation", default="approved correction")
    reset = sub.add_parser("reset")
    reset.add_argument("--alerts-only", action="store_true")
    reset.add_argument("--dry-run", action="store_true")
    reset.add_argument("--status-gid", default="")
    reset.add_argument("--date-gid", default="")
    reset.add_argument("--arrival", default="1970-01-01")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    options = parser()
    a = options.parse_args(argv)
    if a.command == "remediate" and a.approve and a.alert is None:
        options.error("--approve needs --alert")
    spark = spark or SparkSession.builder.appName("tablepulse").getOrCreate()
    root = a.root.rstrip("/")
    tables = open_tables(spark, root)
    now = F.current_timestamp()
    if a.command == "init":
        for name in BASE:
            if not sinks.versions(spark, f"{root}/{name}"):
                sinks.write_version(sinks.empty_table(spark, schemas.TABLES[name]), f"{root}/{name}")
    elif a.command == "load":
        loaded = spark.read.schema(schemas.TABLES[a.table]).parquet(a.source)
        if a.table in BASE:
            sinks.write_version(loaded, f"{root}/{a.table}")
        else:
            highest = loaded.agg(F.max(STATE_KEYS[a.table][0])).first()[0] or 0
            ledger(spark, root, a.table).replace(lambda _: loaded, next_id=highest + 1)
    elif a.command == "kpis":
        tabulated = {name: (tables[t], c) for name, t, c in freight.BREAKDOWNS}
        all_rules = scores.kpi_table(tables, freight.RULES)
        emit(scores.payload(all_rules, freight.RULES, freight.ENTITIES, tabulated))
    elif a.command == "report":
        emit(scores.report(scores.kpi_table(tables, freight.RULES), freight.RULES))
    elif a.command == "drilldown":
        emit(drilldown(tables, freight.RULES, a.kpi))
    elif a.command == "history":
        emit(history.listing(tables["kpi_snapshots"]))
    elif a.command == "snapshot":
        add_capture(history.capture(kpi_table(tables), freight.RULES, a.label, now), ledger(spark, root, "kpi_snapshots"))
    elif a.command == "alerts":
        emit(alerts.pending_alerts(tables["dq_alerts"]))
    elif a.command == "recent-fixes":
        emit(alerts.recent_fixes(tables["dq_alerts"]))
    elif a.command == "monitor":
        ledger(spark, root, "dq_alerts").append_made(
            lambda known, next_id: cycle.detect(tables, freight.SCORED_RULES, wording.ALERT_TEXTS, known, now, next_id - 1)
        )
        emit(alerts.pending_alerts(open_tables(spark, root)["dq_alerts"]))
    elif a.command == "rootcause":
        ledger(spark, root, "dq_alerts").change(lambda known: cycle.explained(tables, freight.RULES, wording.CAUSES, known, a.kpi, now))
        emit(open_tables(spark, root)["dq_alerts"].where(F.col("kpi_id") == a.kpi.upper()))
    elif a.command == "remediate":
        done = cycle.remediate(
            tables, freight.SCORED_RULES, fix_for(a.kpi), tables["dq_alerts"], a.alert, a.explanation, now, a.approve
        )
        emit(done.plan)
        if a.approve:
            emit(done.compared)
            # The capture reads the tables as they were plus the fix, so it is written before new versions are.
            add_capture(done.capture, ledger(spark, root, "kpi_snapshots"))
            write_all(tables, done.tables, root, BASE)
            ledger(spark, root, "dq_alerts").change(lambda known: cycle.closed(known, fix_for(a.kpi), a.alert, a.explanation, now))
    elif a.command == "summary":
        emit(narrative.summary(kpi_table(tables), freight.RULES))
    elif a.command == "chat":
        asked = spark.range(1).select(F.lit(a.message).alias("text"))
        long = history.to_long(tables["kpi_snapshots"], ["overall_score"])
        emit(
            narrative.replies(asked, kpi_table(tables), freight.RULES, long).select(
                "topic", "reply", narrative.text.cited_kpis(F.col("reply"), [r.kpi_id for r in freight.RULES]).alias("cited_kpis")
            )
        )
    elif a.command == "reset":
        undo = () if a.alerts_only else corrections.freight_reversals(a.status_gid, a.date_gid, a.arrival)
        if undo:
            emit(fixes.dry_run(tables, undo))
        if not a.dry_run:
            write_all(tables, fixes.apply_all(tables, undo), root, BASE)
            ledger(spark, root, "dq_alerts").replace(alerts.cleared)
            ledger(spark, root, "kpi_snapshots").replace(lambda known: history.without_label(known, cycle.POST_FIX))


if __name__ == "__main__":
    main()
