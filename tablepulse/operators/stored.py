"""Rates per period, counted once and stored: numerators and denominators by table, period and rule.

A listing of the history then reads a few stored rows. Before it does, the files of the counted tables are compared with
those that the stored counts come from: one digest over paths, sizes and times. Where they differ, only the periods that
changed files touch are counted again, from whole tables filtered to these periods, and laid over the stored counts as
changed rows of a ledger, so that two listings at once cannot spoil each other.

Which periods a file touches:

* files of the table that holds the date: those of its rows. They are logged, so a file that is gone still has them;
* further tables of a joined view: a new file touches the periods its rows meet; where a file is gone or rewritten, the
  periods it met are unknown, and all are counted again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepulse.functions import rates
from tablepulse.operators.history import rates_by_period
from tablepulse.operators.rules import Rule, Tables
from tablepulse.sources.ledger import GONE, Ledger

_STATES = T.StructType([
    T.StructField("view", T.StringType()), T.StructField("captured_at", T.DateType()), T.StructField("kpi_id", T.StringType()),
    T.StructField("num", T.LongType()), T.StructField("den", T.LongType()), T.StructField("dated", T.BooleanType()),
])
_FILES = T.StructType([
    T.StructField("table", T.StringType()), T.StructField("path", T.StringType()), T.StructField("print", T.LongType()),
    T.StructField("view", T.StringType()), T.StructField("periods", T.ArrayType(T.DateType())),
])
LAYOUT = "1:"  # of the stored tables; another one starts anew


@dataclass(frozen=True)
class Dated:
    """Rules counted per period over ``view``, by ``date``, a column of the table ``dated``; the view also reads ``others``."""

    view: str
    date: str
    rules: tuple[Rule, ...]
    dated: str
    others: tuple[str, ...] = ()

    @property
    def tables(self) -> tuple[str, ...]:
        return (self.dated, *self.others)


def month(date: str) -> Column:
    return F.to_date(F.date_trunc("month", date))


def files_of(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """``table, path, print`` of every file below the given paths; names, sizes and times are listed, nothing is read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    mark = F.xxhash64("path", "length", "modificationTime").alias("print")
    parts = [listing.load(path).select(F.lit(name).alias("table"), "path", mark) for name, path in sorted(paths.items())]
    return reduce(DataFrame.unionAll, parts)


class StoredRates:
    """Stored counts of some dated views below ``root``.

    ``load(narrowed)`` gives the tables and views, with the tables named in ``narrowed`` read from the given files only.
    """

    def __init__(
        self, spark: SparkSession, root: str, paths: Mapping[str, str], load: Callable[[Mapping[str, list[str]]], Tables], counted: Iterable[Dated]
    ):
        self.spark, self.load, self.counted = spark, load, tuple(counted)
        used = {t for c in self.counted for t in c.tables}
        self.paths = {name: path for name, path in paths.items() if name in used}
        self.states = Ledger(spark, f"{root}/states", _STATES, ["view", "captured_at", "kpi_id"])
        self.files = Ledger(spark, f"{root}/files", _FILES, ["table", "path", "view"])

    def read(self) -> DataFrame:
        """``captured_at, kpi_id, num, den, value`` per period and rule, as the files are now."""
        head, digest = self.states.head(), self._digest()
        if head.note != digest:
            self.refresh(digest)
            head = self.states.head()
        stored = self.states.read(head)
        period = F.when(F.col("dated"), F.col("captured_at"))
        return stored.select(period.alias("captured_at"), "kpi_id", "num", "den", rates.pct(F.col("num"), F.col("den")).alias("value"))

    def _digest(self) -> str:
        seen = files_of(self.spark, self.paths).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("table", "path", "print")).alias("x")).first()
        rules = LAYOUT + "|".join(f"{c.view}:{r.kpi_id}:{r.measure.hit}:{r.measure.among}" for c in self.counted for r in c.rules)
        return f"{seen.n} {seen.x} {rules}"

    def refresh(self, digest: str) -> None:
        """Count the touched periods again and lay them over the stored ones, then log the files."""
        now = files_of(self.spark, self.paths)
        old = self.files.read()
        logged = old.select("table", "path", "print").distinct()
        added = [tuple(r) for r in now.join(logged, ["table", "path", "print"], "left_anti").select("table", "path").collect()]
        gone = old.join(now, ["table", "path", "print"], "left_anti")
        lost = [(r.view, r.table) for r in gone.select("view", "table").distinct().collect()]
        rules_changed = self.states.head().note.split(" ", 2)[2:] != digest.split(" ", 2)[2:]
        files, counts = [], []
        for c in self.counted:
            new = {t: [path for table, path in added if table == t] for t in c.tables}
            files += [self._periods_by_file(c, t, paths) for t, paths in new.items() if paths]
            whole = rules_changed or any(view == c.view and table != c.dated for view, table in lost)
            if not whole and not any(new.values()) and not any(view == c.view for view, _ in lost):
                continue
            touched = None if whole else self._touched(c, new, gone)
            counts.append(self._recounted(c, touched))
        if counts:
            self.states.change(lambda stored: reduce(DataFrame.unionAll, [make(stored) for make in counts]), note=digest)
        else:
            self.states.change(lambda stored: stored.where("false"), note=digest)
        left = gone.select(*_FILES.names, F.lit(True).alias(GONE))
        self.files.change(lambda _: reduce(DataFrame.unionAll, [left, *(f.withColumn(GONE, F.lit(False)) for f in files)]))
        # Both are small beside the facts: with one segment each, the next listing has nothing to lay over anything.
        self.states.compact()
        self.files.compact()

    def _periods_by_file(self, c: Dated, table: str, paths: list[str]) -> DataFrame:
        """Log rows of new files; only the table with the date says which periods they hold."""
        listed = self.spark.createDataFrame([(path,) for path in paths], "path string")
        here = files_of(self.spark, {table: self.paths[table]}).join(listed, "path", "left_semi")
        none = F.lit(None).cast("array<date>")
        if table != c.dated:
            return here.select("table", "path", "print", F.lit(c.view).alias("view"), none.alias("periods"))
        rows = self.load({table: paths})[table]
        # Here paths are percent-encoded, in listings they are not; a plus sign stands for itself.
        path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        held = rows.groupBy(path.alias("path")).agg(F.collect_set(month(c.date)).alias("held"))
        return here.join(held, "path", "left").select(
            "table", "path", "print", F.lit(c.view).alias("view"), F.coalesce("held", F.array().cast("array<date>")).alias("periods")
        )

    def _touched(self, c: Dated, new: Mapping[str, list[str]], gone: DataFrame) -> list:
        """The periods, few by nature, that new and lost files touch; rows without a date always count as touched."""
        parts = [gone.where((F.col("view") == c.view) & (F.col("table") == c.dated)).select(F.explode("periods").alias("p"))]
        for table, paths in new.items():
            if paths:
                rows = self.load({table: paths})[c.dated if table == c.dated else c.view]
                parts.append(rows.select(month(c.date).alias("p")))
        return sorted(r.p for r in reduce(DataFrame.unionAll, parts).where("p IS NOT NULL").distinct().collect())

    def _recounted(self, c: Dated, touched: list | None) -> Callable[[DataFrame], DataFrame]:
        """Changed rows of the states: the touched periods as they are now, and those that have no rows any more."""
        rows = self.load({})[c.view]
        if touched is not None:
            # The bounds reach the scan of the dated table; the list of periods is exact.
            first, last = (touched[0], touched[-1]) if touched else (None, None)
            between = (F.col(c.date) >= F.lit(first)) & (F.col(c.date) < F.add_months(F.lit(last), 1)) & month(c.date).isin(touched)
            rows = rows.where((between if touched else F.lit(False)) | F.col(c.date).isNull())
        counted = rates_by_period(rows, c.rules, month(c.date))
        # Periods are part of the key; rows without a date are kept under the first day there is.
        no_date = F.lit("0001-01-01").cast("date")
        new = counted.select(
            F.lit(c.view).alias("view"), F.coalesce("captured_at", no_date).alias("captured_at"), "kpi_id", "num", "den",
            F.col("captured_at").isNotNull().alias("dated"),
        )

        def changed(stored: DataFrame) -> DataFrame:
            own = stored.where(F.col("view") == c.view)
            if touched is not None:
                own = own.where(F.col("captured_at").isin([*touched]) | ~F.col("dated")) if touched else own.where(~F.col("dated"))
            over = own.join(new, ["view", "captured_at", "kpi_id"], "left_anti")
            return new.withColumn(GONE, F.lit(False)).unionByName(over.withColumn(GONE, F.lit(True)))

        return changed
