"""Registered queries: against SQL over the given tables where there is some, and the pipeline stage by stage."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from tablepulse.llm import queries
from tests.conftest import TESTDATA

FOLDER = f"{TESTDATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return connection


def plain(value):
    return tuple(value) if isinstance(value, list) else value


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, tables, name):
    found = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    expected = tables.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(row[names.index(c)]) for c in columns) for row in expected.fetchall())
    assert Counter(tuple(plain(row[c]) for c in columns) for row in found.collect()) == want


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op1_length_buckets", "op2_viterbi_counts", "op3_gear_chunks", "op4_line_blocks", "op5_simhash_anchors", "op7_quotation_links"])
def test_other_queries_return_whole_tables(spark, name):
    found = queries.QUERIES[name](spark, FOLDER)
    rows = found.count()
    whole = {"op4_line_blocks": "pages", "op7_quotation_links": "conversations", "op2_viterbi_counts": "documents", "op5_simhash_anchors": "documents"}
    if name in whole:
        assert rows == spark.read.parquet(f"{FOLDER}/{whole[name]}.parquet").count()
    assert rows > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "near duplicates", "benchmark decontamination", "packing",
    ]
    before, text = docs, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.cut(stage(spark, before, FOLDER), "stage")
        assert after.dtypes == docs.dtypes
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()} and len(ids) == after.count()
        before = after
        text = after
    packed = corpus_pipeline.run(spark, FOLDER).groupBy("doc_id").sum("length").collect()
    words = {r.doc_id: len(r.text.split()) for r in text.collect() if r.text.split()}
    assert {r.doc_id: r[1] for r in packed} == words
