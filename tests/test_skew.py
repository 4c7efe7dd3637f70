"""A key with a third of all rows: results stay whole, and joins split it instead of sending it to one task."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablepulse.operators import fixes
from tablepulse.operators.drilldown import failing_rows
from tablepulse.operators.joins import not_in
from tablepulse.operators.measure import measure, reconcile_groups
from tablepulse.operators.narrative import conversation_tail
from tablepulse.operators.rules import find_rule
from tablepulse.plans import corrections
from tablepulse.plans.freight import RULES
from tablepulse.session import scratch_dir

N = 300_000
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "32",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
}


@pytest.fixture(scope="module")
def skewed(spark):
    """Orders and links in which the key 'hot' owns a third of the rows; the hot order has many weights."""
    before = {k: spark.conf.get(k) for k in SETTINGS if spark.conf.get(k, None) is not None}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    root = scratch_dir(spark, "skew")
    hot = F.col("id") % 3 == 0
    key = F.when(hot, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 20011).cast("string")))
    links = spark.range(0, N, 1, 16).select(
        F.col("id").cast("string").alias("os_id"),
        key.alias("order_release_gid"),
        F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("shipment_gid"),
        F.lit(1.0).cast("float").alias("quantity_kg"),
        F.lit("No").alias("otm_deleted"),
        F.lit("Active").alias("lake_status"),
        F.lit("OK").alias("dq_flag"),
    )
    orders = spark.range(0, N // 2, 1, 16).select(
        key.alias("order_release_gid"),
        F.when(hot, F.col("id")).otherwise(F.lit(5)).cast("float").alias("total_weight_kg"),
        F.lit("Shipped").alias("order_status"),
        F.lit("OK").alias("dq_flag"),
        F.lit("2025-06-01").cast("date").alias("order_date"),
    )
    links.write.parquet(f"{root}/links")
    orders.where("order_release_gid <> 'hot'").write.parquet(f"{root}/cold_orders")
    orders.write.parquet(f"{root}/orders")
    yield {
        "order_shipment": spark.read.parquet(f"{root}/links"),
        "order": spark.read.parquet(f"{root}/orders"),
        "cold": spark.read.parquet(f"{root}/cold_orders"),
    }
    for k in SETTINGS:
        spark.conf.set(k, before[k]) if k in before else spark.conf.unset(k)


def count_rows():
    """The row count, and an aggregate that keeps a column in the shuffle: bare equal keys compress to nothing."""
    return F.count(F.lit(1)).alias("n"), F.max("os_id").alias("last")


def run(df) -> tuple:
    """A one-row result and whether a join in the executed plan was split."""
    row = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return row[0], "SortMergeJoin(skew=true)" in plan


def test_hot_orphans_are_split(skewed):
    tables = {"order": skewed["cold"], "order_shipment": skewed["order_shipment"]}
    orphans = failing_rows(tables, find_rule(RULES, "JI02"))
    row, split = run(orphans.agg(*count_rows()))
    assert row.n == N // 3 and split
    counted = measure(tables, [find_rule(RULES, "JI02")]).first()
    assert (counted.num, counted.den) == (N // 3, N)


def test_deleting_orphans_splits_the_kept_rows(skewed):
    row, split = run(fixes.apply(skewed, corrections.ORPHANS).agg(*count_rows()))
    assert row.n == N and split


def test_not_in_splits_the_left_side(skewed):
    left, right = skewed["order_shipment"], skewed["cold"]
    row, split = run(not_in(left, "order_release_gid", right, "order_release_gid").agg(*count_rows()))
    assert row.n == N // 3 and split


def test_many_weights_of_one_order_are_split(skewed, duck):
    rule = find_rule(RULES, "CS01")
    groups = reconcile_groups(skewed["order"], skewed["order_shipment"], rule.measure)
    row, split = run(groups.agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("s")))
    assert split
    measured = measure(skewed, [rule])
    counted, split = run(measured)
    assert split, "the join of the hot key's record with its 50 000 groups is split"
    # Hot: one group per weight, each against the same sum. Others: copies x links against weight 5.
    weights = [float(i) for i in range(0, N // 2, 3)]
    total = float(len(range(0, N, 3)))
    hot_failing = sum(abs(total - w) > w * 0.05 for w in weights)
    links = {k: 0 for k in range(20011)}
    copies = dict(links)
    for i in range(N):
        if i % 3:
            links[i % 20011] += 1
            copies[i % 20011] += i < N // 2
    cold_failing = sum(1 for k in links if copies[k] and abs(copies[k] * links[k] - 5) > 0.25)
    assert counted.num == hot_failing + cold_failing
    assert row.n == len(weights) + sum(1 for k in copies if copies[k])


def test_a_long_conversation_sends_only_its_last_turns(spark, skewed):
    turns = spark.range(0, N, 1, 16).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000).alias("conv_id"),
        F.col("id").alias("turn"),
        F.lit("user").alias("role"),
        F.col("id").cast("string").alias("text"),
    )
    tail = conversation_tail(turns).where("conv_id = 0").first()
    newest = sorted((i for i in range(N) if i % 3 == 0 or i % 5000 == 0), reverse=True)[:5]
    assert tail.preamble == "".join(f"\nUser: {i}" for i in reversed(newest))
