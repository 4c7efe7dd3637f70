"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run once to warm up and then timed (best of two) from building the plan to the last row,
written to the no-op sink so that no time goes into fetching rows. ``kpi_table_per_rule`` counts the same
rules one query at a time; it is the plan the one-pass ``kpi_table`` replaces.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablepulse.operators import scores  # noqa: E402
from tablepulse.plans import warehouse  # noqa: E402
from tablepulse.plans.queries import QUERIES  # noqa: E402
from tablepulse.session import local_session  # noqa: E402

HEADLINE = (
    "kpi_table",
    "kpi_rag",
    "pillar_scores",
    "entity_scores",
    "kpi_payload",
    "ji01_match_rate",
    "ji02_orphan_rate",
    "ji03_resolve_rate",
    "cs01_sum_mismatch_rate",
    "cs07_ambiguous_rate",
    "cs02_date_order_rate",
    "breakdown_return_flag",
    "drilldown_ji01",
    "drilldown_ji02",
    "drilldown_cs01",
    "drilldown_cs07",
    "drilldown_tp01",
    "failing_samples",
    "history_delta",
    "history_not_captured",
    "snapshot_wide",
    "alerts_raised",
    "alerts_ranked",
    "rca_records",
    "fix_orphans",
    "fix_dry_run",
    "fix_before_after",
    "derive_shipments",
    "screen_statements",
    "extract_tokens",
    "parse_json",
    "conversation_tail",
    "summary_text",
)
REPEATS = 2


def per_rule(spark, folder):
    """One KPI at a time, each with its own scans."""
    for rule in warehouse.SCORED_RULES:
        run(scores.kpi_table(warehouse.load(spark, folder), [rule]))


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def seconds(job) -> float:
    start = time.perf_counter()
    job()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    jobs = {name: lambda name=name: run(QUERIES[name](spark, folder)) for name in HEADLINE}
    jobs["kpi_table_per_rule"] = lambda: per_rule(spark, folder)
    times = {}
    for name, job in jobs.items():
        job()
        times[name] = round(min(seconds(job) for _ in range(REPEATS)), 3)
    total = round(sum(t for name, t in times.items() if name != "kpi_table_per_rule"), 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
             "sf": os.path.basename(folder.rstrip("/")), "cpus": cpus}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
