"""Tables kept as a log of commits: several writers, changed rows, stored counts."""

from __future__ import annotations

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablepulse.operators import history
from tablepulse.operators.rules import RowRate, Rule
from tablepulse.operators.stored import Dated, StoredRates
from tablepulse.session import scratch_dir
from tablepulse.sources.ledger import CHANGES, GONE, Ledger
from tablepulse.sources.sinks import file_system

SCHEMA = "id long, name string, n long"


def ledger(spark, key=("id",)):
    schema = spark.createDataFrame([], SCHEMA).schema
    return Ledger(spark, scratch_dir(spark, "ledger"), schema, key)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(table):
    return Counter(map(tuple, table.read().collect()))


def test_append_change_delete_compact(spark):
    table = ledger(spark)
    assert table.read().count() == 0 and table.head().version == 0
    table.append(rows_of(spark, [(1, "a", 1), (2, "b", 2), (3, "c", 3), (None, "none", 0), (1, "twin", 9)]))
    table.change(lambda rows: rows.where("id = 2").withColumn("name", F.lit("B")))
    assert content(table) == Counter([(1, "a", 1), (1, "twin", 9), (2, "B", 2), (3, "c", 3), (None, "none", 0)])
    table.append(rows_of(spark, [(2, "later", 5)]))  # a row appended after the change stays beside it
    table.delete(F.col("name") == "B")
    assert content(table)[(2, "later", 5)] == 1, "other rows of the key stay"
    table.update(F.col("name") == "none", lambda rows: rows.withColumn("n", F.lit(0)))
    table.append(rows_of(spark, [(2, "again", 6)]))
    want = Counter([(1, "a", 1), (1, "twin", 9), (2, "later", 5), (3, "c", 3), (None, "none", 0), (2, "again", 6)])
    assert content(table) == want
    before = table.head()
    table.compact()
    assert content(table) == want and len(table.head().segments) == 1
    assert Counter(map(tuple, table.read(before).collect())) == want, "earlier commits stay readable"


def test_a_change_writes_the_changed_rows_alone(spark):
    table = ledger(spark)
    table.append(spark.range(1000).selectExpr("id", "'x' AS name", "id AS n"))
    commit = table.change(lambda rows: rows.where("id = 77").withColumn("name", F.lit("y")))
    last = commit.segments[-1]
    assert last.kind == CHANGES and spark.read.parquet(f"{table.root}/{last.path}").count() == 1
    assert table.read().where("name = 'y'").count() == 1 and table.read().count() == 1000
    unchanged = table.change(lambda rows: rows.where("false"))
    assert unchanged.version == commit.version, "nothing changed, nothing committed"


def test_the_latest_of_several_changes_wins(spark):
    table = ledger(spark)
    table.append(rows_of(spark, [(i, "a", 0) for i in range(5)]))
    for n in range(1, 4):
        table.change(lambda rows, n=n: rows.where(F.col("id") <= n).withColumn("n", F.lit(n)))
    assert {r.id: r.n for r in table.read().collect()} == {0: 3, 1: 3, 2: 3, 3: 3, 4: 0}


def test_interleaved_writers_number_their_rows_apart(spark):
    """A second writer commits while the first one is between reading and committing."""
    table = ledger(spark)
    calls = []

    def numbered(batch, first, second=None):
        def make(present, next_id):
            calls.append((first, next_id))
            if second and len([c for c in calls if c[0] == first]) == 1:
                second()
            return history.with_next_ids(batch, next_id - 1, "id", ["n"])
        return make

    other = rows_of(spark, [(None, "other", n) for n in range(3)])
    mine = rows_of(spark, [(None, "mine", n) for n in range(2)])
    table.append_made(numbered(mine, "mine", lambda: table.append_made(numbered(other, "other"))))
    assert calls == [("mine", 1), ("other", 1), ("mine", 4)]
    assert sorted((r.id, r.name) for r in table.read().collect()) == [(1, "other"), (2, "other"), (3, "other"), (4, "mine"), (5, "mine")]
    assert table.head().next_id == 6


def test_interleaved_loads_of_one_batch_add_it_once(spark):
    table = ledger(spark)
    batch = rows_of(spark, [(None, f"k{i}", i) for i in range(4)])
    tried = []

    def new_rows(nested):
        def make(present, next_id):
            fresh = batch.join(present.select("name"), "name", "left_anti").select(*batch.columns)
            tried.append(nested)
            if nested == "outer" and tried.count("outer") == 1:
                table.append_made(new_rows("inner"))
            return history.with_next_ids(fresh, next_id - 1, "id", ["n"])
        return make

    table.append_made(new_rows("outer"))
    assert tried == ["outer", "inner", "outer"]
    assert sorted(r.id for r in table.read().collect()) == [1, 2, 3, 4]


def test_blind_appends_and_changes_of_two_writers_both_count(spark):
    table = ledger(spark)
    table.append(rows_of(spark, [(1, "a", 0), (2, "b", 0)]))
    once = []

    def mine(rows):
        if not once:
            once.append(True)
            table.change(lambda r: r.where("id = 2").withColumn("n", F.col("n") + 10))
            table.append(rows_of(spark, [(3, "c", 0)]))
        return rows.where("id <> 1").withColumn("n", F.col("n") + 1)

    table.change(mine)
    assert {r.id: r.n for r in table.read().collect()} == {1: 0, 2: 11, 3: 1}


def test_unlisted_files_and_unfinished_commits_are_ignored(spark):
    table = ledger(spark)
    table.append(rows_of(spark, [(1, "a", 0)]))
    rows_of(spark, [(9, "lost", 0)]).write.parquet(f"{table.root}/segments/lost")
    draft, fs = file_system(spark, f"{table.root}/_commits/000000000002.json.draft")
    fs.create(draft, False).close()
    assert content(table) == Counter([(1, "a", 0)]) and table.head().version == 1


# ---- stored counts per period ----

FACTS = "id long, at timestamp_ntz, parent long, bad boolean"
PARENTS = "pid long, since timestamp_ntz"


def fact(i, month, parent, bad):
    return (i, dt.datetime(2024, month, 1 + i % 28), parent, bad)


@pytest.fixture
def store(spark):
    folder = scratch_dir(spark, "facts")
    paths = {"facts": f"{folder}/the facts+50%", "parents": f"{folder}/parents of +%20"}  # names that are encoded in places
    schemas = {"facts": FACTS, "parents": PARENTS}

    def load(narrowed):
        tables = {n: spark.read.schema(schemas[n]).parquet(*narrowed.get(n, [paths[n]])) for n in paths}
        tables["joined"] = tables["facts"].join(tables["parents"], F.col("parent") == F.col("pid"))
        return tables

    def rule(kpi_id, view):
        return Rule(kpi_id, kpi_id, "p", "o", 0, False, RowRate(view, "bad"))

    counted = (Dated("facts", "at", (rule("F", "facts"),), "facts"), Dated("joined", "since", (rule("J", "joined"),), "parents", ("facts",)))

    def write(name, rows, number):
        spark.createDataFrame(rows, schemas[name]).coalesce(1).write.mode("append").parquet(f"{paths[name]}/part={number}")

    write("facts", [fact(i, 1 + i % 3, i % 4, i % 2 == 0) for i in range(30)] + [(99, None, 0, True)], 0)
    write("parents", [(p, dt.datetime(2023, 1 + p, 5)) for p in range(5)], 0)
    return StoredRates(spark, f"{folder}/state", paths, load, counted), load, write, paths


def expected(load):
    tables, found = load({}), {}
    for view, date, kpi in (("facts", "at", "F"), ("joined", "since", "J")):
        for r in tables[view].select(date, "bad").collect():
            month = r[0] and r[0].date().replace(day=1)
            num, den = found.get((month, kpi), (0, 0))
            found[month, kpi] = (num + r.bad, den + 1)
    return found


def stored(store):
    return {(r.captured_at, r.kpi_id): (r.num, r.den) for r in store.read().collect()}


def test_stored_counts_follow_the_files(spark, store, monkeypatch):
    kept, load, write, paths = store
    recounted = []
    touched_of = StoredRates._recounted
    monkeypatch.setattr(StoredRates, "_recounted", lambda self, c, touched: (recounted.append((c.view, touched)), touched_of(self, c, touched))[1])

    def month(m, year=2024):
        return dt.date(year, m, 1)

    assert stored(kept) == expected(load) and recounted == [("facts", None), ("joined", None)] or not recounted.clear()
    recounted.clear()
    assert stored(kept) == expected(load) and recounted == [], "nothing changed, nothing is counted"

    write("facts", [fact(200 + i, 2, 1, True) for i in range(5)], 1)  # February, all of the parent of February 2023
    assert stored(kept) == expected(load)
    assert recounted == [("facts", [month(2)]), ("joined", [month(2, 2023)])]
    recounted.clear()

    write("parents", [(9, dt.datetime(2023, 9, 1)), (0, dt.datetime(2023, 7, 1))], 1)
    assert stored(kept) == expected(load)
    assert recounted == [("joined", [month(7, 2023), month(9, 2023)])]
    recounted.clear()

    gone, fs = file_system(spark, f"{paths['parents']}/part=0")
    fs.delete(gone, True)
    assert stored(kept) == expected(load)
    assert recounted == [("joined", [month(m, 2023) for m in range(1, 6)])], "periods of a lost file come from the log"
    recounted.clear()

    gone, fs = file_system(spark, f"{paths['facts']}/part=1")
    fs.delete(gone, True)
    assert stored(kept) == expected(load)
    assert recounted == [("facts", [month(2)]), ("joined", None)], "lines that are gone may have met any period"


def test_a_listing_reads_stored_rows_only(spark, store):
    kept, *_ = store
    kept.read().collect()
    plan = kept.read()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "the facts" not in plan and "the%20facts" not in plan
