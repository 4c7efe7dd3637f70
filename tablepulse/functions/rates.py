"""Rates, scores and status as column expressions.

All rounding is done on integers counted in tenths of a percent, so the result does not depend on
binary floating point: a rate is ``(2000 n + d) div 2d`` tenths, which is exact half-up rounding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score and status rules.
PERFECT = 100
POINTS_PER_PERCENT_OVER = 10
RED_SHARE_OF_TARGET = 95  # higher-is-better: red below 95 % of the target
RED_MULTIPLE_OF_TARGET = 2  # lower-is-better: red above twice the target


def _ratio_tenths(n: Column, d: Column) -> Column:
    """``1000 n / d`` rounded half up to an integer; NULL when ``d`` is 0."""
    return F.call_function("div", n * 2000 + d, F.nullif(d * 2, F.lit(0).cast("long")))


def tenths(percent: Column) -> Column:
    """A one-decimal percentage as an integer number of tenths."""
    return F.round(percent * 10).cast("long")


def pct(n: Column, d: Column) -> Column:
    """``n / d`` as a percentage with one decimal; 0 when the denominator is 0."""
    n, d = n.cast("long"), d.cast("long")
    return F.when(d == 0, F.lit(0.0)).otherwise(_ratio_tenths(n, d) / F.lit(10.0))


def round_half_even(x: Column) -> Column:
    """Nearest integer as DOUBLE, ties to the even neighbour."""
    return F.bround(x, 0)


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


# Rates and targets are compared as whole millionths, so a target keeps the decimals it is given.
_UNITS = 1_000_000


def _exact(percent: Column) -> Column:
    return F.round(percent * _UNITS).cast("long")


def score(value: Column, target: Column, higher_is_better: Column) -> Column:
    """0..100 score of a rate against its target, with one decimal.

    Higher is better: share of the target reached, at most 100. Lower is better: 100 up to the
    target, then ten points off per percent above it, at least 0.
    """
    v, t = _exact(value), _exact(target)
    reached = F.when(t == 0, F.lit(float(PERFECT))).otherwise(
        F.least(_ratio_tenths(v, t) / F.lit(10.0), F.lit(float(PERFECT)))
    )
    full = F.lit(PERFECT * _UNITS).cast("long")
    kept = clamp(full - (v - t) * POINTS_PER_PERCENT_OVER, F.lit(0).cast("long"), full)
    tenths_kept = F.call_function("div", kept * 20 + _UNITS, F.lit(2 * _UNITS))
    return F.when(higher_is_better, reached).otherwise(tenths_kept / F.lit(10.0))


def rag(value: Column, target: Column, higher_is_better: Column) -> Column:
    """RED, AMBER or GREEN. A lower-is-better target of 0 has no amber band."""
    v, t = _exact(value), _exact(target)
    above_floor = F.when(v * 100 < t * RED_SHARE_OF_TARGET, "RED").when(v < t, "AMBER")
    below_ceiling = F.when(v > t * RED_MULTIPLE_OF_TARGET, "RED").when(v > t, "AMBER")
    return F.coalesce(F.when(higher_is_better, above_floor).otherwise(below_ceiling), F.lit("GREEN"))


def deviation(value: Column, target: Column, higher_is_better: Column) -> Column:
    """Distance from the target relative to the target; larger is worse in either direction."""
    gap = F.when(higher_is_better, target - value).otherwise(value - target)
    return gap / F.greatest(target, F.lit(1.0))


def meets_target(value: Column, target: Column, higher_is_better: Column) -> Column:
    """Spotless KPIs for the summary: target reached, or a lower-is-better rate of exactly 0."""
    return F.when(higher_is_better, value >= target).otherwise(value == 0)


def target_text(target: Column, higher_is_better: Column) -> Column:
    """The target as people read it: ``≥ 98%``, ``≤ 1%``, ``= 0%``."""
    sign = F.when(higher_is_better, "≥").when(target == 0, "=").otherwise("≤")
    number = F.regexp_replace(target.cast("string"), r"\.0$", "")
    return F.concat(sign, F.lit(" "), number, F.lit("%"))


def utc_text(moment: Column) -> Column:
    """A timestamp as UTC text to the second, whatever the session's time zone."""
    utc = F.to_utc_timestamp(moment, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd HH:mm:ss 'UTC'")
