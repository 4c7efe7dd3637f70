"""Text and JSON columns, conversation tails, derived shipments."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepulse.functions import rates, text
from tablepulse.operators.derive import derive_shipments
from tablepulse.operators.drilldown import failing_sample
from tablepulse.operators.narrative import compact_context, conversation_tail
from tablepulse.plans import warehouse
from tablepulse.session import shuffle_settings
from tablepulse.sources import schemas, sinks


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "statement,safe,reason",
    [
        ("DROP TABLE orders", False, "blocked keyword: DROP"),
        ("truncate table orders", False, "blocked keyword: TRUNCATE"),
        ("ALTER TABLE a.b.c ADD COLUMN x INT", False, "blocked keyword: ALTER"),
        ("DELETE FROM a.b.c", False, "DELETE without WHERE"),
        ("UPDATE t SET a = 1 WHERE b = 2; DELETE FROM t WHERE b = 3", False, "more than one statement"),
        ("UPDATE t SET a = 1", False, "UPDATE without WHERE"),
        ("UPDATE t SET a = 1 WHERE b = 2 ; \n ", True, ""),
        ("delete from t\nwhere b = 2", True, ""),
        ("UPDATE t SET dropped = 1 WHERE b = 2", True, ""),
        ("DROP TABLE a; DELETE FROM b", False, "blocked keyword: DROP"),
        (None, False, "no statement"),
        ("DELETE FROM t -- WHERE x", False, "DELETE without WHERE"),
        ("DELETE FROM t /* WHERE x */", False, "DELETE without WHERE"),
        ("UPDATE t SET n = 'WHERE' || \"where\"", False, "UPDATE without WHERE"),
        ("UPDATE t SET m = 1 WHERE n = 'a;b'", True, ""),
        ("UPDATE t SET m = 'drop -- it' WHERE `alter` = 1 -- truncate; alter", True, ""),
        ("UPDATE t SET m = 'it''s; /* so' WHERE b = 'x\\'; drop'", True, ""),
        ("DELETE FROM t WHERE a = 1 -- don't\n; DROP TABLE t", False, "blocked keyword: DROP"),
        ("DELETE FROM t WHERE a = 1 /* ; */; UPDATE t SET a = 1 WHERE b = 2", False, "more than one statement"),
        ("DELETE/**/FROM t WHERE/**/a = 1", True, ""),
        ("DELETE FROM t WHERE a = 'open", False, "unclosed quotation or comment"),
        ("DELETE FROM t WHERE a = 1 /* open", False, "unclosed quotation or comment"),
        ("UPDATE t SET a = '" + "xyz" * 20000 + "''" * 300 + "' WHERE b = 1 /*" + "*" * 50000 + "*/", True, ""),
        ("", True, ""),
    ],
)
def test_statement_screen(spark, statement, safe, reason):
    assert one(spark, statement, text.screen_statement) == (safe, reason)


def test_cited_kpis(spark):
    def cited(column):
        return text.cited_kpis(column, [r.kpi_id for r in warehouse.RULES])

    assert one(spark, "See cs07, CS-07 and Biz03; not CS03 or XJI01.", cited) == ["BIZ03", "CS07"]
    assert one(spark, "CP-04, ri05s or RI-05", cited) == ["CP04", "RI05", "RI05S"]
    assert one(spark, "nothing", cited) == []


@pytest.mark.parametrize(
    "message,topic",
    [
        ("What is the overall state?", "overall"), ("SCORE of the ghost rows", "overall"), ("why CS-07", "ghost"),
        ("Orphans?", "orphan"), ("Remediation please", "fix"), ("last week", "trend"), ("hello", "general"),
    ],
)
def test_routing(spark, message, topic):
    assert one(spark, message, text.route) == topic


ANSWER = T.StructType([T.StructField("kpi_id", T.StringType()), T.StructField("n", T.LongType())])


@pytest.mark.parametrize(
    "answer,parsed",
    [
        ('{"kpi_id": "CS07", "n": 3}', ("CS07", 3)),
        ('```json\n{"kpi_id": "CS07",\n "n": 3}\n```', ("CS07", 3)),
        ('```\n{"kpi_id": "CS07", "n": 3}', ("CS07", 3)),
        ('\x1b[1;32m{"kpi_id": "CS07"}\x1b[0m', ("CS07", None)),
        ("  ", None), ("I am not sure.", None), ('{"kpi_id": "CS07", "n": 3', None), (None, None),
    ],
)
def test_json_answers(spark, answer, parsed):
    found = one(spark, answer, lambda c: text.parse_json(c, ANSWER))
    assert found.parsed == parsed
    assert (found.error is None) == (parsed is not None)


def test_shuffle_settings():
    small, large = shuffle_settings(1 << 20, 8), shuffle_settings(1 << 40, 4000)
    assert small["spark.sql.shuffle.partitions"] == "16" and large["spark.sql.shuffle.partitions"] == "8192"


def test_conversation_tail(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"m{t}") for t in range(1, 9)] + [(2, 1, None, "hi")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: (r.n_turns, r.preamble) for r in conversation_tail(turns).collect()}
    assert found[1] == (5, "\nAssistant: m4\nUser: m5\nAssistant: m6\nUser: m7\nAssistant: m8")
    assert found[2] == (1, "\nUser: hi")


def test_failing_sample_keeps_the_total(spark):
    rows = [("A", i) for i in range(25)] + [("B", 1)]
    found = failing_sample(spark.createDataFrame(rows, "kpi_id string, k int"), ["k"]).collect()
    a = [r for r in found if r.kpi_id == "A"]
    assert sorted(r.k for r in a) == list(range(20)) and {(r.total_failing, r.note) for r in a} == {(25, "...and 5 more rows")}
    assert [(r.total_failing, r.note) for r in found if r.kpi_id == "B"] == [(1, "")]


def test_compact_context(spark):
    kpis = spark.createDataFrame(
        [("JI02", 2.7, 1.0, False)], "kpi_id string, value double, target_val double, higher_is_better boolean"
    )
    captures = spark.createDataFrame([(None, 85.0)], "label string, overall_score double")
    found = {(r.kind, r.body) for r in compact_context(kpis, captures).collect()}
    assert found == {("kpi", '{"value":2.7,"target":"≤ 1%"}'), ("capture", '{"label":"","overall_score":85.0}')}


def test_rates_are_exact(spark):
    pairs = [(n, d) for d in (1, 3, 7, 16, 94, 100, 111, 113) for n in range(0, 2 * d + 1)]
    found = spark.createDataFrame(pairs, "n long, d long").select("n", "d", rates.pct(F.col("n"), F.col("d")).alias("p")).collect()
    for n, d, p in found:
        assert p == ((2000 * n + d) // (2 * d)) / 10.0
    big = spark.sql("SELECT 10L * 1000000000000 AS n, 30L * 1000000000000 AS d").select(rates.pct(F.col("n"), F.col("d"))).first()[0]
    assert big == 33.3


@pytest.mark.parametrize(
    "value,target,higher,score,status",
    [
        (94.0, 98.0, True, 95.9, "AMBER"), (93.1, 98.0, True, 95.0, "AMBER"), (93.0, 98.0, True, 94.9, "RED"),
        (99.0, 98.0, True, 100.0, "GREEN"), (5.0, 0.0, True, 100.0, "GREEN"), (2.0, 1.0, False, 90.0, "AMBER"),
        (2.1, 1.0, False, 89.0, "RED"), (1.0, 1.0, False, 100.0, "GREEN"), (50.0, 0.0, False, 0.0, "RED"),
    ],
)
def test_score_and_status(spark, value, target, higher, score, status):
    args = (F.lit(value), F.lit(target), F.lit(higher))
    assert spark.range(1).select(rates.score(*args), rates.rag(*args)).first()[:] == (score, status)


def test_derived_shipments(spark):
    day = dt.date(2025, 6, 10)
    flags = [
        # flag, deleted, lake, order status -> status, flag, travelled
        ("Zero Qty", "YES", "STALE", "Cancelled", "Planned", "Zero Weight", False),
        ("Ghost Stale Delete", "No", "Active", "Shipped", "Planned", "Ghost - OS link deleted in source system", False),
        ("Cancelled Order", "YES", "STALE", "Cancelled", "Planned", "Ghost - OS link deleted in source system", False),
        ("Cancelled Order", "No", "Active", "Shipped", "Cancelled", "OK", False),
        ("OK", "No", "Active", "Cancelled", "Cancelled", "OK", False),
        ("Re-assigned", "No", "Active", "Planned", "Closed", "Re-assigned (active)", True),
        ("Split Qty Mismatch", "No", "Active", "Planned", "Closed", "Split Shipment", True),
        ("OK", "No", "Active", "Shipped", "Closed", "OK", True),
        ("OK", "No", "Active", "Planned", "Planned", "OK", False),
        (None, "No", "Active", "Planned", "Planned", "OK", False),
        ("Orphan", "No", "Active", None, "Closed", "OK", True),
    ]
    links = [
        {"os_id": str(i), "order_release_gid": f"o{i}", "shipment_gid": f"s{i}", "quantity_kg": float(i), "otm_deleted": f[1],
         "lake_status": f[2], "dq_flag": f[0]}
        for i, f in enumerate(flags)
    ]
    links += [{**links[0], "shipment_gid": "known"}, {**links[0], "shipment_gid": None}]
    orders = [
        {"order_release_gid": f"o{i}", "order_date": day, "order_status": f[3]} for i, f in enumerate(flags) if f[3]
    ]
    link_table = sinks.literal_batch(spark, links, schemas.ORDER_SHIPMENT)
    order_table = sinks.literal_batch(spark, orders, schemas.ORDER)
    present = sinks.literal_batch(spark, [{"shipment_gid": "known"}], schemas.SHIPMENT)
    derived = derive_shipments(link_table, order_table, present)
    assert derive_shipments(link_table, order_table, present.unionByName(derived)).count() == 0
    assert [(f.name, f.dataType) for f in derived.schema] == [(f.name, f.dataType) for f in schemas.SHIPMENT]
    found = {r.shipment_gid: r for r in derived.collect()}
    assert len(found) == len(flags)
    for i, (*_, status, flag, travelled) in enumerate(flags):
        row = found[f"s{i}"]
        start = dt.date(2025, 6, 1) if flags[i][3] is None else day
        assert (row.status, row.dq_flag, row.weight_kg) == (status, flag, float(i))
        assert (row.planned_pickup, row.planned_delivery) == (start + dt.timedelta(1), start + dt.timedelta(3))
        assert (row.actual_arrival == row.planned_delivery) is travelled
        assert (row.actual_departure is None) is not travelled


@pytest.mark.parametrize(
    "value,target,higher,score,status",
    [
        (0.3, 0.25, False, 99.5, "AMBER"), (0.6, 0.25, False, 96.5, "RED"), (0.2, 0.25, False, 100.0, "GREEN"),
        (0.5, 0.25, False, 97.5, "AMBER"), (0.1, 0.0, False, 99.0, "RED"), (0.0, 0.0, False, 100.0, "GREEN"),
        (95.0, 98.25, True, 96.7, "AMBER"), (93.3, 98.25, True, 95.0, "RED"), (98.3, 98.25, True, 100.0, "GREEN"),
        (50.0, 0.0, True, 100.0, "GREEN"), (99.9, 0.0, False, 0.0, "RED"),
    ],
)
def test_targets_are_compared_exactly(spark, value, target, higher, score, status):
    row = spark.createDataFrame([(value, target, higher)], "v double, t double, h boolean")
    args = (F.col("v"), F.col("t"), F.col("h"))
    found = row.select(rates.score(*args).alias("score"), rates.rag(*args).alias("status")).first()
    assert (found.score, found.status) == (score, status)
