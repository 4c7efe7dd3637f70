"""Session helpers: a local session for tests and the bench, and the shared scratch folder."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A ``local[cores]`` session. On a cluster, use the session the cluster gives you instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tablepulse")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach: ``spark.checkpoint.dir`` or the context's checkpoint directory.

    Where neither is set, it is a folder in the warehouse, which only a local session is known to reach; others get an
    error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.sparkContext.master.startswith("local") and warehouse.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"{warehouse}/_scratch"
    return shared.rstrip("/")


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new, unique folder path below the shared folder."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def state_dir(spark: SparkSession, purpose: str, about: str) -> str:
    """The folder path below the shared folder for what is kept about ``about``, the same in every session."""
    return f"{shared_dir(spark)}/{purpose}-{hashlib.sha256(about.encode()).hexdigest()[:24]}"


def shuffle_settings(shuffled_bytes: int, cores: int) -> dict[str, str]:
    """Settings for a session that shuffles this much: partitions of about 128 MB, at least two per core.

    The first number of partitions is an upper bound; adaptive execution merges small ones and splits
    skewed ones.
    """
    partitions = max(2 * cores, -(-shuffled_bytes // (128 << 20)))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.shuffle.partitions": str(partitions),
    }


def buckets(stored_bytes: int) -> int:
    """A number of buckets of about 256 MB each, a power of two, so that tables of several sizes can be told to share one."""
    return 1 << max(0, (-(-stored_bytes // (256 << 20)) - 1).bit_length())
