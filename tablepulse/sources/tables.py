"""Reading tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class TableSet(Mapping[str, DataFrame]):
    """Named tables that are opened when first asked for, and views made from them."""

    def __init__(self, openers: Mapping[str, Callable[[Mapping[str, DataFrame]], DataFrame]]):
        self._openers = dict(openers)
        self._opened: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self._openers[name](self)
        return self._opened[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._openers)

    def __len__(self) -> int:
        return len(self._openers)


def read_tables(spark: SparkSession, folder: str, schemas: Mapping[str, T.StructType]) -> TableSet:
    """``folder/<name>.parquet`` for every declared schema; scans read only the columns in use."""
    return TableSet(
        {n: lambda _, n=n: spark.read.schema(schemas[n]).parquet(f"{folder}/{n}.parquet") for n in schemas}
    )


def catalog_tables(spark: SparkSession, schema: str, names: Iterable[str]) -> TableSet:
    """``schema.<name>`` from the session catalog; ``schema`` may be ``catalog.schema``."""
    return TableSet({n: lambda _, n=n: spark.table(f"{schema}.`{n}`") for n in names})


def with_views(
    base: Mapping[str, DataFrame], views: Mapping[str, Callable[[Mapping[str, DataFrame]], DataFrame]]
) -> TableSet:
    """The base tables, unopened, and views over them by name."""
    return TableSet({**{n: lambda _, n=n: base[n] for n in base}, **views})


def preview(df: DataFrame, order: Iterable[str], limit: int = 5) -> DataFrame:
    """The first rows in a given total order, NULLs last."""
    return df.orderBy(*map(F.asc_nulls_last, order)).limit(limit)
