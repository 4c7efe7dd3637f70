"""Connected components of a graph that is only held as a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablepulse.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of the undirected edges ``a, b`` (BIGINT): the smallest node of its component.

    Large-star and small-star steps alternate: each node links its larger neighbours, then its smaller ones, to
    its smallest neighbour, until every component is a star around its smallest node. The number of rounds grows
    with the logarithm of the longest chain. A node's smallest neighbour is a map-side combined minimum, but its
    edges meet it in one task: the minimum is grouped by the key of the join, so adaptive execution does not split
    it. Callers keep nodes small by linking trees instead of all pairs. Only two numbers per round reach the driver. No edges give no rows; loops and repeats are harmless.
    """
    star = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        size = star.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(size) == before or not size[0]:
            return star.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(
                star.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        before = tuple(size)
        star = cut(_small_star(_large_star(star)), "edges")


def _large_star(star: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the smallest of the node and its neighbours."""
    both = star.unionAll(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.where("u <> v").distinct()


def _small_star(star: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = star.groupBy("u").agg(F.min("v").alias("m"))
    linked = star.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return linked.unionAll(least.select("u", F.col("m").alias("v"))).distinct()
