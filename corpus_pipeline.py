"""From raw documents to packed training sequences.

Every stage takes ``(spark, docs, folder)`` and returns a DataFrame that is written as Parquet before the next stage
reads it, so a stage starts from files and no plan spans two stages. All stages but the last keep the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablepulse.llm import decontam, line_templates, packing, quality, simhash
from tablepulse.llm.common import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that any quality rule rejects go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Lines of templates that recur across documents go, but for the first; every document stays, if only empty."""
    return line_templates.without_recurring_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of every group of near duplicates stays, the one with the smallest id."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with at least a twentieth of their words in benchmark passages go."""
    return decontam.keep_clean(docs, table(spark, folder, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every token of the documents in length buckets and token-budget batches."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packed),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; only the last one's rows are returned unwritten."""
    docs = table(spark, folder, "documents")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, folder)
        docs = cut(docs, name.replace(" ", "-")) if number < len(STAGES) else docs
    return docs


# The near-duplicate stage links SimHash fingerprints, which SQL cannot express.
ORACLE_SQL = None
