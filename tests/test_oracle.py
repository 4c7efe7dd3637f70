"""Every registered query against its SQL, over the whole sf0.001 tables."""

from __future__ import annotations

import math
import os

import pytest

import __spark_entry__ as entry
from oracle import ORACLE_SQL
from tablepulse.plans.queries import QUERIES
from tests.conftest import TESTDATA

FOLDER = f"{TESTDATA}/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


# Queries that read NULLs or repeated rows differently if written carelessly.
NULL_SENSITIVE = tuple(
    name
    for name in sorted(QUERIES)
    if name.startswith(("drilldown_", "fix_", "alerts_", "history", "unlabelled_"))
    or name in ("kpi_report", "kpi_payload", "failing_samples", "rca_records", "derive_shipments", "conversation_tail",
                "parse_json", "screen_statements", "preview_orders", "compact_context", "chat_replies")
)


def views(folder):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


@pytest.fixture(scope="module")
def tables():
    return views(FOLDER)


@pytest.fixture(scope="module")
def dirty(tmp_path_factory):
    """The tables with 3 % NULLs in every column, 5 % repeated rows, and a third of the lines on one order."""
    import duckdb

    folder = tmp_path_factory.mktemp("dirty")
    c = duckdb.connect()
    c.execute("SET threads = 1")
    c.execute("SELECT setseed(0.42)")
    for name in TABLES:
        source = f"read_parquet('{FOLDER}/{name}.parquet')"
        columns = [r[0] for r in c.execute(f"DESCRIBE SELECT * FROM {source}").fetchall()]
        holes = ", ".join(f"CASE WHEN random() < 0.03 THEN NULL ELSE {x} END AS {x}" for x in columns)
        c.execute(
            f"""CREATE OR REPLACE TABLE t AS SELECT {holes} FROM (SELECT * FROM {source}
                UNION ALL (SELECT * FROM {source} USING SAMPLE 5% (bernoulli, 7)))"""
        )
        if name == "lineitem":
            c.execute("UPDATE t SET l_orderkey = 7 WHERE l_partkey % 3 = 0")
        c.execute(f"COPY t TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder), views(folder)


def normal(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, tables, name):
    same_rows(spark, tables, FOLDER, name)


@pytest.mark.parametrize("name", NULL_SENSITIVE)
def test_query_matches_sql_on_dirty_tables(spark, dirty, name):
    folder, connection = dirty
    same_rows(spark, connection, folder, name)


def same_rows(spark, connection, folder, name):
    found = QUERIES[name](spark, folder)
    columns = sorted(found.columns)
    expected = connection.execute(ORACLE_SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    rows = expected.fetchall()
    left = sorted((tuple(normal(r[c]) for c in columns) for r in found.collect()), key=repr)
    right = sorted((tuple(normal(row[names.index(c)]) for c in columns) for row in rows), key=repr)
    assert left == right


def test_entry_is_the_kpi_table(spark):
    table = entry.entry(spark)
    assert table.columns == ["kpi_id", "num", "den", "value", "target_val", "higher_is_better"]
    assert table.count() == 14
