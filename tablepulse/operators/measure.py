"""Counting: every rule becomes one ``(kpi_id, num, den)`` row.

Plan shape, whatever the number of rules:

* all rules that relate the same parent and child key share one shuffle. Both sides are stacked and
  grouped by the key, so the map-side combine shrinks a key to one record per task before anything
  is shuffled. There is no sort, and a key that owns a third of either table costs no more than any
  other key;
* a reconciliation is part of the same pass where all parent rows of a key have one amount: the record then
  holds the amount and its number of rows. Only the records of keys with several amounts are joined to the
  parent's (key, amount) groups, over the same shuffle of records. They are shuffled once more for this join, so
  that both of its sides are plain shuffles and a key with very many amounts is split. Such a record is counted
  once, with its key's smallest amount, however many groups the key has;
* row rates of a table are counted in the same pass if the table takes part in one, otherwise all of
  them share one scan and one global aggregate.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepulse.operators.rules import (
    AmbiguousRate,
    KeyedRate,
    MatchRate,
    OrphanRate,
    ReconcileRate,
    ResolveRate,
    RowRate,
    Rule,
    Tables,
)


def measure(tables: Tables, rules: Iterable[Rule], by: str | None = None) -> DataFrame:
    """Count all rules: ``kpi_id, num, den``, one row per rule.

    With ``by``, a column that every table has, rows are counted apart for each of its values: ``by, kpi_id, num, den``.
    A value that no row of a rule's tables has gives no row.
    """
    by_table: dict[str, list[Rule]] = {}
    by_pair: dict[tuple, list[Rule]] = {}
    for rule in rules:
        m = rule.measure
        if isinstance(m, RowRate):
            by_table.setdefault(m.table, []).append(rule)
            continue
        group = m.pair
        if isinstance(m, ReconcileRate) and any(isinstance(r.measure, ReconcileRate) for r in by_pair.get(group, ())):
            group = (*group, rule.kpi_id)  # one set of (key, amount) groups per pass
        by_pair.setdefault(group, []).append(rule)
    parts = []
    for (parent, child, *_), group in by_pair.items():
        sides = [by_table.pop(table, []) for table in (parent, child)] if parent != child else [[], []]
        parts.append(_keyed_rates(tables, group, *sides, by=by))
    parts += [_row_rates(tables[t], group, by) for t, group in by_table.items()]
    return reduce(DataFrame.unionAll, parts)


def row_counts(tables: Tables) -> DataFrame:
    """``table_name, n_rows`` of every table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionAll, parts)


def _long(totals: DataFrame, rules: list[Rule], by: str | None = None) -> DataFrame:
    """Wide rows ``num_i, den_i`` -> long rows."""
    rows = [
        f"named_struct('kpi_id', '{r.kpi_id}', 'num', coalesce(CAST(num_{i} AS BIGINT), 0L),"
        f" 'den', coalesce(CAST(den_{i} AS BIGINT), 0L))"
        for i, r in enumerate(rules)
    ]
    return totals.selectExpr(*([by] if by else []), f"inline(array({', '.join(rows)}))")


def _totals(df: DataFrame, aggregates: list[str], by: str | None) -> DataFrame:
    """One row of aggregates, or one per value of ``by``."""
    return df.groupBy(*([by] if by else [])).agg(*map(F.expr, aggregates))


def _row_rates(df: DataFrame, rules: list[Rule], by: str | None = None) -> DataFrame:
    counts: list[str] = []
    for i, rule in enumerate(rules):
        counts += [f"count_if({rule.measure.hit}) AS num_{i}", f"count_if({rule.measure.among}) AS den_{i}"]
    return _long(_totals(df, counts, by), rules, by)


class _Side:
    """Per-key aggregates of one table, each expression evaluated and shuffled once."""

    def __init__(self, prefix: str, key: str):
        self.prefix = prefix
        self.key = key
        self.inputs: dict[str, str] = {}
        self.merges: dict[str, str] = {}

    def need(self, function: str, expression: str) -> str:
        """The name of ``function(expression)`` per key."""
        column = self.inputs.setdefault(expression, f"{self.prefix}_in_{len(self.inputs)}")
        return self.merges.setdefault(f"{function}({column})", f"{self.prefix}_{len(self.merges)}")

    def rows(self, df: DataFrame, by: str | None) -> DataFrame:
        also = [by] if by else []
        return df.selectExpr(f"{self.key} AS key", *also, *(f"{e} AS {c}" for e, c in self.inputs.items()))

    def aggregates(self) -> list[Column]:
        return [F.expr(f"{call} AS {name}") for call, name in self.merges.items()]


def _ones(predicate: str) -> str:
    return "1L" if predicate == "true" else f"CASE WHEN {predicate} THEN 1L ELSE 0L END"


def _only(predicate: str, value: str) -> str:
    return value if predicate == "true" else f"CASE WHEN {predicate} THEN {value} END"


def _numerator(m: KeyedRate, parent: _Side, child: _Side, once: str) -> str:
    """The numerator of a rule as an aggregate over the per-key records.

    ``once`` picks one of the rows that a record has after the join to its (key, amount) groups.
    """
    parents = f"CASE WHEN key IS NULL THEN 0L ELSE coalesce({parent.need('sum', _ones(m.parent_where))}, 0L) END"
    active = f"coalesce({child.need('sum', _ones(m.child_where))}, 0L)"
    if isinstance(m, MatchRate):
        return f"count_if({once} AND {parents} > 0 AND {active} > 0)"
    if isinstance(m, OrphanRate):
        return f"sum(CASE WHEN {once} AND {parents} = 0 THEN {active} END)"
    if isinstance(m, ResolveRate):
        return f"sum(CASE WHEN {once} THEN {parents} * {active} END)"
    if isinstance(m, AmbiguousRate):
        # More than one distinct value is the same as min < max, which combines map-side.
        value = _only(m.child_where, m.child_value)
        return f"count_if({once} AND {child.need('min', value)} < {child.need('max', value)})"
    if isinstance(m, ReconcileRate):
        total = child.need("sum", _only(m.child_where, m.child_amount))
        off = off_by_more(f"_copies * CAST({total} AS DOUBLE)", "_amount", m.tolerance)
        return f"count_if({active} > 0 AND {off})"
    raise TypeError(f"unknown measure {type(m).__name__}")


def _keyed_rates(
    tables: Tables, rules: list[Rule], of_parent: list[Rule], of_child: list[Rule], by: str | None = None
) -> DataFrame:
    """Rules of one pair of tables, and row rates of these two tables."""
    first: KeyedRate = rules[0].measure
    parent, child = _Side("p", first.parent_key), _Side("c", first.child_key)
    reconciled = [r.measure for r in rules if isinstance(r.measure, ReconcileRate)]
    once = "true"
    if reconciled:
        m = reconciled[0]
        # Rows without a key have no amount here, so no filter on the key is needed that would make other records of it.
        amount = f"CASE WHEN ({m.parent_key}) IS NOT NULL AND ({m.parent_where}) THEN {m.parent_amount} END"
        smallest, largest = parent.need("min", amount), parent.need("max", amount)
        copies = parent.need("sum", _ones(f"({m.parent_where}) AND ({m.parent_amount}) IS NOT NULL"))
        once = f"(_amount IS NULL OR _amount = {smallest})"

    def summed(side: _Side, predicate: str) -> str:
        return f"sum(CASE WHEN {once} THEN {side.need('sum', _ones(predicate))} END)"

    totals: list[str] = []
    for rule in rules:
        counted = child if isinstance(rule.measure, (OrphanRate, ResolveRate)) else parent
        totals += [_numerator(rule.measure, parent, child, once), summed(counted, "true")]
    for side, row_rules in ((parent, of_parent), (child, of_child)):
        for rule in row_rules:
            totals += [summed(side, rule.measure.hit), summed(side, rule.measure.among)]
    named = [f"{t} AS {'den' if i % 2 else 'num'}_{i // 2}" for i, t in enumerate(totals)]

    both = parent.rows(tables[first.parent], by).unionByName(
        child.rows(tables[first.child], by), allowMissingColumns=True
    )
    per_key = both.groupBy("key", *([by] if by else [])).agg(*parent.aggregates(), *child.aggregates())
    if not reconciled:
        return _long(_totals(per_key, named, by), [*rules, *of_parent, *of_child], by)

    several = F.expr(f"coalesce({smallest} < {largest}, false)")
    single = per_key.where(~several).selectExpr("*", f"{smallest} AS _amount", f"{copies} AS _copies")
    groups = _amount_groups(tables[first.parent], reconciled[0], by)
    # The hash in the condition keeps the partitioning of the records from being used for the join; structs are compared
    # because no filter on NULLs follows from that.
    here = (F.xxhash64("key") == F.xxhash64("_group_key")) & (F.struct("key") == F.struct(F.col("_group_key").alias("key")))
    # No group has more rows than its key. With this, both branches need the same columns, and so the same shuffle.
    here &= F.col("_copies") <= F.col(copies)
    mixed = per_key.where(several).join(groups, here & (F.col(by) == F.col("_group_by")) if by else here)
    both = _totals(single, named, by).unionAll(_totals(mixed, named, by))
    names = [n for i in range(len(totals) // 2) for n in (f"num_{i}", f"den_{i}")]
    return _long(_totals(both, [f"sum({n}) AS {n}" for n in names], by), [*rules, *of_parent, *of_child], by)


def _amount_groups(parent: DataFrame, m: ReconcileRate, by: str | None = None) -> DataFrame:
    """The parent's (key, amount) groups and their number of rows; a group without either is never tested."""
    also = [F.col(by).alias("_group_by")] if by else []
    rows = parent.where(F.expr(m.parent_where)).select(
        F.expr(m.parent_key).alias("_group_key"), F.expr(m.parent_amount).alias("_amount"), *also
    )
    known = rows.where("_group_key IS NOT NULL AND _amount IS NOT NULL")
    return known.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_copies"))


def off_by_more(total: str, amount: str, tolerance: float) -> str:
    return f"abs({total} - {amount}) > {amount} * {tolerance}D"


def reconcile_groups(parent: DataFrame, child: DataFrame, m: ReconcileRate, *also: str) -> DataFrame:
    """``key, amount, *also, total`` for every parent group that has active child rows.

    Both sides are aggregated to their group before the join, so copies of a parent row become a
    factor instead of repeated join rows. The sums are grouped by the key and its hash so that both
    sides are shuffled once more by the key alone: a key with very many parent groups can then be split
    by adaptive execution.
    """
    groups = (
        parent.where(F.expr(m.parent_where))
        .groupBy(F.expr(m.parent_key).alias("key"), F.expr(m.parent_amount).alias("amount"), *also)
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    sums = (
        child.where(F.expr(m.child_where))
        .groupBy(F.xxhash64(F.expr(m.child_key)), F.expr(m.child_key).alias("key"))
        .agg(F.sum(F.expr(m.child_amount)).alias("child_total"))
        .select("key", "child_total")
    )
    joined = groups.join(sums, "key")
    return joined.select("key", "amount", *also, (F.col("copies") * F.col("child_total").cast("double")).alias("total"))
