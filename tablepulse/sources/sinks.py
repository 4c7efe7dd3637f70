"""Writing tables: create, append, reload, versions, CSV export, check after load.

Parquet has no row updates, so a changed table is written as a new version folder; a folder that is
being read is never overwritten.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return literal_batch(spark, [], schema)


def literal_batch(spark: SparkSession, rows: Iterable[Mapping[str, Any]], schema: T.StructType) -> DataFrame:
    """Rows given in code, as a DataFrame with exactly this schema."""
    batch = pa.Table.from_pylist(list(rows), schema=to_arrow_schema(schema))
    return spark.createDataFrame(batch, schema)


def create_if_absent(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """An empty table with typed columns; an existing table is left alone."""
    empty_table(spark, schema).write.mode("ignore").parquet(path)


def create_tables(spark: SparkSession, schema: str, tables: Mapping[str, T.StructType]) -> None:
    """``CREATE SCHEMA`` and ``CREATE TABLE`` in the session catalog, where they do not exist yet."""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    for name, struct in tables.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in struct.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {schema}.`{name}` ({columns}) USING parquet")


def insert_into(df: DataFrame, schema: str, table: str) -> None:
    """Append to a catalog table, matching columns by name."""
    df.write.mode("append").format("parquet").saveAsTable(f"{schema}.`{table}`")


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str) -> DataFrame:
    """A catalog table over files that are hashed into buckets by ``key`` and sorted within them.

    Tables with as many buckets of the same key are joined and grouped by it without any shuffle, as often as they are
    read; the shuffle is paid once, here. Rows are brought together by bucket first, so that a bucket is one file of a
    task instead of one per task. ``session.buckets`` proposes a number.
    """
    hashed = df.repartition(buckets, key)
    hashed.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def reload(df: DataFrame, path: str) -> None:
    """Replace all rows. ``df`` must not read ``path``."""
    df.write.mode("overwrite").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV part files with a header line each."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def load_report(df: DataFrame, column: str) -> DataFrame:
    """Check after a load: rows per value of ``column``, with the total beside it.

    The total is the sum of the groups, whose number the caller's choice of a status-like column bounds.
    """
    counted = df.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counted.withColumn("total_rows", total).orderBy(F.desc("n"), "label")


def counted_load(df: DataFrame, path: str, column: str, labels: Iterable[str]) -> DataFrame:
    """Replace all rows below ``path`` and report on them like ``load_report``, from counts taken while they are written.

    ``labels`` are the values that the column is known to have; all others are reported together as ``(other)``.
    """
    labels = list(labels)
    value = F.col(column).cast("string")
    counts = [F.count_if(value == label).alias(f"n_{i}") for i, label in enumerate(labels)]
    seen = Observation()
    reload(df.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(value.isNull()).alias("none"), *counts), path)
    found = seen.get
    named = [(label, found.get(f"n_{i}", 0)) for i, label in enumerate(labels)] + [(None, found.get("none", 0))]
    total = found.get("n", 0)
    named.append(("(other)", total - sum(n for _, n in named)))
    rows = [{"label": label, "n": n, "total_rows": total} for label, n in named if n]
    schema = T.StructType([T.StructField("label", T.StringType()), T.StructField("n", T.LongType()), T.StructField("total_rows", T.LongType())])
    return literal_batch(df.sparkSession, rows, schema).orderBy(F.desc("n"), "label")


def file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, root: str, finished: bool = False) -> list[int]:
    target, fs = file_system(spark, root)
    if not fs.exists(target):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(target)]
    kept = [n for n in names if n.startswith("v=")]
    if finished:
        kept = [n for n in kept if fs.exists(file_system(spark, f"{root}/{n}/_SUCCESS")[0])]
    return sorted(int(n[2:]) for n in kept)


def versions(spark: SparkSession, root: str) -> list[int]:
    """Finished versions below ``root``, oldest first; unfinished writes are skipped."""
    return _numbers(spark, root, finished=True)


def write_version(df: DataFrame, root: str) -> int:
    """Write the next version and return its number.

    A version is never overwritten: if another writer has begun one of this number, the next one is taken.
    """
    number = max(_numbers(df.sparkSession, root), default=0) + 1
    while True:
        try:
            df.write.mode("errorifexists").parquet(f"{root}/v={number}")
        except AnalysisException as taken:
            if taken.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            number += 1
        else:
            return number


def append_to_latest(df: DataFrame, root: str) -> None:
    """Add rows to the latest version, as new files in its folder; the first version if there is none."""
    known = versions(df.sparkSession, root)
    if known:
        append(df, f"{root}/v={known[-1]}")
    else:
        write_version(df, root)


def read_version(spark: SparkSession, root: str, schema: T.StructType, number: int | None = None) -> DataFrame:
    """A given version, or the latest one; an empty table if there is none yet."""
    known = versions(spark, root)
    if number is None and not known:
        return empty_table(spark, schema)
    return spark.read.schema(schema).parquet(f"{root}/v={number if number is not None else known[-1]}")
