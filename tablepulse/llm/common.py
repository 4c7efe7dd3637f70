"""Shared pieces: words, lines, once-evaluated expressions, tables written to the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepulse.session import scratch_dir

# The white space that separates words.
SPACE = "[\\x20\\x09-\\x0D]"
_SPACE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body or its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for NULL."""
    trimmed = F.btrim(text, F.lit(_SPACE_CHARS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, f"{SPACE}+")).otherwise(F.array().cast("array<string>"))


def text_hash(text: Column) -> Column:
    """Tells rows of one ``doc_id`` apart; rows that agree in both are copies and share every result."""
    return F.xxhash64(text)


def cut(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and a lost executor costs a reread."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same_row(left: tuple[Column, Column], right: tuple[Column, Column]) -> Column:
    """Join condition on (doc_id, text hash), where a missing doc_id equals a missing doc_id."""
    return left[0].eqNullSafe(right[0]) & (left[1] == right[1])
