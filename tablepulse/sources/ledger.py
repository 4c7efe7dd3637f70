"""Tables that several writers append to and change: a log of commits over files that are never rewritten.

A commit lists all *segments* of the table, each a folder of Parquet files. A segment holds either further rows or
changed rows: whole rows that replace all those of their keys in the segments before it, or take them away. A reader lays the
changed rows over the rest, so changing a few rows writes a few rows. ``compact`` writes the present rows as one segment.

A writer reads the latest commit, makes its rows from that state, writes them to a folder of their own, and then creates
the next commit, which fails if another writer has created it in the meantime. Then everything is made anew from the
other writer's state. Numbers for new rows are part of the commit, so no two writers give the same ones. What a failed
writer leaves behind is listed nowhere.

Commits need an atomic "create unless it exists": a hard link on local disks, elsewhere a rename that does not replace,
as on HDFS. A commit holds folder names only, so it stays small; compaction bounds their number.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepulse.sources.sinks import empty_table, file_system

ROWS, CHANGES = "rows", "changes"
GONE = "_gone"
ATTEMPTS = 50


@dataclass(frozen=True)
class Segment:
    path: str
    kind: str = ROWS


@dataclass(frozen=True)
class Commit:
    """The whole table as of one version; ``note`` is free text of the writers."""

    version: int = 0
    segments: tuple[Segment, ...] = ()
    next_id: int = 1
    note: str = ""
    compacted: bool = False  # the rows of the base are in the segments


def _same_key(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)))


def overlaid(rows: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """``rows`` with the latest changes of each key laid over them.

    Both have ``_epoch``: the changes of an epoch replace all rows of their keys from smaller epochs. They also say, in
    ``_gone``, whether a row goes. Only the changes are grouped; the rows meet one small record per changed key, which
    Spark broadcasts if it is small enough. A missing key is a key like any other.
    """
    columns = [c for c in rows.columns if c != "_epoch"]
    names = [f"_key_{c}" for c in key]
    latest = changes.groupBy(*(F.col(c).alias(n) for c, n in zip(key, names, strict=True))).agg(F.max("_epoch").alias("_at"))
    kept = rows.join(latest, _same_key(key, names) & (F.col("_epoch") < F.col("_at")), "left_anti")
    laid = changes.where(~F.col(GONE)).join(latest, _same_key(key, names) & (F.col("_epoch") == F.col("_at")), "left_semi")
    return kept.select(*columns).unionAll(laid.select(*columns))


class Ledger:
    """One table below ``root``; ``key`` names the columns by which rows are changed.

    With ``base`` the table begins with these rows, which stay where they are; only changes and further rows are written.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: Iterable[str] = (), base: DataFrame | None = None):
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, tuple(key)
        self.base = None if base is None else self._typed(base)

    # ---- reading ----

    def head(self) -> Commit:
        """The latest commit; an empty one before the first."""
        target, fs = file_system(self.spark, f"{self.root}/_commits")
        names = [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        return self.at(max(numbers)) if numbers else Commit()

    def at(self, version: int) -> Commit:
        target, fs = file_system(self.spark, self._commit_path(version))
        stream = fs.open(target)
        try:
            stored = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        segments = tuple(Segment(**s) for s in stored.pop("segments"))
        return Commit(version, segments, **stored)

    def read(self, commit: Commit | None = None) -> DataFrame:
        """The rows as of a commit, the latest by default."""
        commit = commit or self.head()
        epochs: list[list[str]] = [[]]
        changes: list[tuple[int, str]] = []
        for segment in commit.segments:
            if segment.kind == CHANGES:
                changes.append((len(epochs), segment.path))
                epochs.append([])
            else:
                epochs[-1].append(segment.path)
        parts = [(e, self._files(paths, self.schema)) for e, paths in enumerate(epochs) if paths]
        if self.base is not None and not commit.compacted:
            parts.append((0, self.base))
        parts = parts or [(0, empty_table(self.spark, self.schema))]
        if not changes:
            return reduce(DataFrame.unionAll, [rows for _, rows in parts])
        parts = [rows.withColumn("_epoch", F.lit(e)) for e, rows in parts]
        marked = T.StructType([*self.schema.fields, T.StructField(GONE, T.BooleanType())])
        over = [self._files([path], marked).withColumn("_epoch", F.lit(e)) for e, path in changes]
        return overlaid(reduce(DataFrame.unionAll, parts), reduce(DataFrame.unionAll, over), self.key)

    def _files(self, paths: Iterable[str], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{p}" for p in paths))

    # ---- writing ----

    def append(self, rows: DataFrame) -> Commit:
        """Rows that do not depend on the table: written once, however many others commit before."""
        path, _ = self._write(self._typed(rows))
        return self._commit(lambda head: replace(head, segments=(*head.segments, Segment(path))))

    def append_made(self, make: Callable[[DataFrame, int], DataFrame]) -> Commit:
        """Append ``make(present rows, next free number)``; it is called anew if another writer commits first."""

        def build(head: Commit) -> Commit:
            path, n = self._write(self._typed(make(self.read(head), head.next_id)))
            return replace(head, segments=(*head.segments, Segment(path)), next_id=head.next_id + n) if n else head

        return self._commit(build)

    def change(self, make: Callable[[DataFrame], DataFrame], note: str | None = None) -> Commit:
        """Rows to replace all rows of their keys: ``make(present rows)``; with a true ``_gone`` column, rows that go."""
        marked = T.StructType([*self.schema.fields, T.StructField(GONE, T.BooleanType())])

        def build(head: Commit) -> Commit:
            changed = make(self.read(head))
            if GONE not in changed.columns:
                changed = changed.withColumn(GONE, F.lit(False))
            path, n = self._write(self._typed(changed, marked))
            told = head if note is None else replace(head, note=note)
            return replace(told, segments=(*head.segments, Segment(path, CHANGES))) if n else told

        return self._commit(build)

    def update(self, which: Column, make: Callable[[DataFrame], DataFrame]) -> Commit:
        """``change`` for rows in ``which``; ``make`` gets these and any others of the same keys."""
        names = [f"_key_{c}" for c in self.key]

        def of_keys(rows: DataFrame) -> DataFrame:
            hit = rows.where(which).select(*(F.col(c).alias(n) for c, n in zip(self.key, names, strict=True)))
            return rows.join(hit, _same_key(self.key, names), "left_semi")

        return self.change(lambda rows: make(of_keys(rows)))

    def delete(self, which: Column) -> Commit:
        """Rows in ``which`` go."""
        return self.update(which, lambda rows: rows.withColumn(GONE, F.coalesce(which, F.lit(False))))

    def compact(self) -> Commit:
        """The present rows as one segment; readers of earlier commits keep their files."""

        return self.replace(lambda rows: rows)

    def replace(self, make: Callable[[DataFrame], DataFrame], next_id: int = 1) -> Commit:
        """``make(present rows)`` instead of them, as one segment; numbers below ``next_id`` are taken."""

        def build(head: Commit) -> Commit:
            path, n = self._write(self._typed(make(self.read(head))))
            return replace(head, segments=(Segment(path),) if n else (), next_id=max(next_id, head.next_id), compacted=True)

        return self._commit(build)

    def _typed(self, rows: DataFrame, schema: T.StructType | None = None) -> DataFrame:
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in (schema or self.schema).fields))

    def _write(self, rows: DataFrame) -> tuple[str, int]:
        """A new segment and its number of rows, counted while they are written."""
        path, seen = f"segments/{uuid.uuid4().hex}", Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.root}/{path}")
        return path, seen.get.get("n", 0)

    def _commit(self, build: Callable[[Commit], Commit]) -> Commit:
        for _ in range(ATTEMPTS):
            head = self.head()
            new = build(head)
            if new == head:
                return head
            new = replace(new, version=head.version + 1)
            if self._create(self._commit_path(new.version), json.dumps({k: v for k, v in asdict(new).items() if k != "version"})):
                return new
        raise RuntimeError(f"{ATTEMPTS} commits to {self.root} were overtaken by other writers")

    def _commit_path(self, version: int) -> str:
        return f"{self.root}/_commits/{version:012}.json"

    def _create(self, path: str, text: str) -> bool:
        """Create a file with its whole content, unless it exists."""
        draft, fs = file_system(self.spark, f"{path}.{uuid.uuid4().hex}")
        target, _ = file_system(self.spark, path)
        stream = fs.create(draft, False)
        stream.write(text.encode())
        stream.close()
        if fs.getScheme() == "file":
            try:
                os.link(draft.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            finally:
                fs.delete(draft, False)
            return True
        done = not fs.exists(target) and fs.rename(draft, target)
        if not done:
            fs.delete(draft, False)
        return done
