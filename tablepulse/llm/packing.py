"""Packing into length buckets whose boundaries waste the least padding, and token-budget batches inside them.

Sequences longer than ``max_length`` are cut into pieces of that length and a rest, so no token is lost and the global
histogram of lengths has at most ``max_length`` rows. Dynamic programming over that histogram finds the ``n_buckets``
upper bounds for which the padding (bound minus length, summed over all pieces) is smallest. Every piece goes to the
bucket with the smallest bound that holds it. A batch of a bucket has as many rows as the token budget allows at the
bucket's bound; only the last batch of a bucket may be shorter.

Numbering inside a bucket is spread over shards of about ``SHARD_ROWS`` pieces: a shard numbers its own pieces and adds
the count of the shards before it, so a bucket that holds most of the corpus is not numbered by one task.

Documents without tokens (NULL or empty texts) form no piece and do not come out. Repeated rows are pieces like any
other. Other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablepulse.llm.common import cut, text_hash, words

MAX_LENGTH = 2048
N_BUCKETS = 16
BATCH_TOKENS = 32_768
SHARD_ROWS = 100_000


def best_bounds(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> tuple[list[int], int]:
    """The bucket bounds with the least padding for a histogram sorted by length, and that padding.

    ``best[k][j]``: least padding of the first j lengths in k buckets. The last bucket holds the lengths i..j-1 and
    pads them to length j-1, so best[k][j] = min over i of best[k-1][i] + cost(i, j). Ties take the smallest i.
    """
    n = len(lengths)
    rows = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    tokens = np.concatenate(([0], np.cumsum(counts * lengths, dtype=np.int64)))
    buckets = min(n_buckets, n)
    never = np.iinfo(np.int64).max // 4
    best = np.full(n + 1, never, np.int64)
    best[0] = 0
    choices = []
    for _ in range(buckets):
        now, choice = np.full(n + 1, never, np.int64), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            choice[j] = np.argmin(cost)
            now[j] = cost[choice[j]]
        best = now
        choices.append(choice)
    bounds, j = [], n
    for choice in reversed(choices):
        bounds.append(int(lengths[j - 1]))
        j = int(choice[j])
    return bounds[::-1], int(best[n])


def pieces(docs: DataFrame, length: Column, max_length: int = MAX_LENGTH) -> DataFrame:
    """``doc_id, text_hash, piece, start, length``: every document's tokens, cut at ``max_length``."""
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_hash"), length.cast("long").alias("tokens")
    ).where("tokens > 0")
    last = F.call_function("div", F.col("tokens") - 1, F.lit(max_length))
    cutting = sized.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * max_length
    return cutting.select(
        "doc_id", "text_hash", "piece", start.alias("start"), F.least(F.lit(max_length), F.col("tokens") - start).cast("long").alias("length")
    )


def buckets(cut_docs: DataFrame, n_buckets: int = N_BUCKETS) -> list[int]:
    """The best bounds for ``pieces``; the histogram that reaches the driver has a row per length."""
    histogram = cut_docs.groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy("length").collect()
    if not histogram:
        return []
    lengths, counts = (np.array([r[c] for r in histogram], np.int64) for c in ("length", "n"))
    return best_bounds(lengths, counts, n_buckets)[0]


def pack(
    docs: DataFrame,
    length: Column | None = None,
    max_length: int = MAX_LENGTH,
    n_buckets: int = N_BUCKETS,
    batch_tokens: int = BATCH_TOKENS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``doc_id, piece, start, length, bucket, batch, slot``: one row per piece.

    ``bucket`` is the bound to which the piece is padded, ``batch`` numbers the batches of the bucket and ``slot`` the
    rows of the batch, both from 0. ``length`` counts a document's tokens; by default its words.
    """
    spark = docs.sparkSession
    found = cut(pieces(docs, F.size(words(F.col("text"))) if length is None else length, max_length), "pieces")
    bounds = buckets(found, n_buckets)
    total = found.count()
    shards = max(1, -(-total // shard_rows))
    ends = pa.table({"from_length": pa.array([0, *bounds][:-1] if bounds else [], pa.int64()), "bucket": pa.array(bounds, pa.int64())})
    of_length = spark.createDataFrame(ends).select("bucket", F.explode(F.sequence(F.col("from_length") + 1, F.col("bucket"))).alias("length"))
    dealt = found.join(F.broadcast(of_length), "length")  # at most max_length rows
    shard = F.pmod(F.xxhash64("doc_id", "text_hash", "piece"), F.lit(shards))
    dealt = dealt.withColumn("shard", shard)
    counts = dealt.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("bucket", "shard").orderBy(F.asc_nulls_first("doc_id"), "text_hash", "piece")
    numbered = dealt.withColumn("own", F.row_number().over(own) - 1).join(offsets, ["bucket", "shard"])
    place = F.col("offset") + F.col("own")
    rows = F.greatest(F.lit(1), F.call_function("div", F.lit(batch_tokens), F.col("bucket")))
    return numbered.select(
        "doc_id", "piece", "start", "length", "bucket",
        F.call_function("div", place, rows).alias("batch"), (place % rows).cast("long").alias("slot"),
    )
