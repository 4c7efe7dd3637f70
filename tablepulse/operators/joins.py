"""Semi- and anti-joins: NULL behaviour, and keys that own a large share of either side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_keys(df: DataFrame, key: str, name: str) -> DataFrame:
    """One row per non-NULL key, as column ``name``, for the right side of a semi- or anti-join.

    Repeated keys are combined map-side, so a hot key on this side shrinks before the shuffle. They are
    grouped by the key *and* its hash, so the join still shuffles the result by the key alone: adaptive
    execution splits a hot key on the left side only where both inputs of the join are plain shuffles,
    which they are not if an aggregate by the same key feeds the join directly.
    """
    keys = df.select(F.expr(key).alias(name)).where(F.col(name).isNotNull())
    return keys.groupBy(F.xxhash64(name), name).agg(F.lit(True).alias("_any")).select(name)


def not_in(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """``left_key NOT IN (SELECT right_key ...)`` with its NULL rules, as a shuffled anti-join.

    One NULL on the right removes every row, and a NULL on the left is kept only if the right side
    is empty. Spark runs the SQL form by broadcasting the whole right side; here the keys meet in an
    ordinary anti-join. The two facts about the right side are counted over the same set of distinct
    keys, NULL among them, so one scan and shuffle of the right side serves both: the join compares
    one-field structs, for which no filter on NULLs is inferred that would make its keys a different set.
    """
    keys = right.select(F.expr(right_key).alias("_present")).groupBy(F.xxhash64("_present"), "_present").agg(F.lit(True).alias("_any"))
    keys = keys.select("_present")
    facts = keys.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count("_present").alias("n_known")).alias("facts")).scalar()
    absent = left.join(keys, F.struct(F.col(left_key)) == F.struct(F.col("_present")), "left_anti")
    certain = (facts["n"] == facts["n_known"]) & (F.col(left_key).isNotNull() | (facts["n"] == 0))
    return absent.where(certain)
