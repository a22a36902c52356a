"""Parquet table access for the driver's data folders."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


BALANCE_CONF = "spark.wardstats.balanceMinBytes"
BALANCE_MIN_BYTES = 1 << 20


def _size_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the plan (file sizes for a scan)."""
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return int(size if isinstance(size, int) else size.toString())  # py4j may convert BigInt itself
    except Exception:  # noqa: BLE001 - estimate unavailable
        return None


def balance(df: DataFrame) -> DataFrame:
    """Spread a scan that yields fewer partitions than the cluster has cores.

    A parquet file with one row group is read by one task however it is
    split, so all per-row work up to the first shuffle would run on one
    core. When the scan has fewer partitions than ``defaultParallelism`` and
    is big enough for that to matter (``spark.wardstats.balanceMinBytes``,
    default 1 MiB) the rows are dealt round-robin to that many partitions.
    On a cluster a large input already has far more partitions than cores
    and this is a no-op. Filters and column pruning still reach the scan
    below it."""
    spark = df.sparkSession
    try:
        target = spark.sparkContext.defaultParallelism
        parts = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD API (e.g. Spark Connect): leave the scan as is
        return df
    min_bytes = int(spark.conf.get(BALANCE_CONF, str(BALANCE_MIN_BYTES)))
    if parts < target:
        size = _size_bytes(df)
        if size is None or size >= min_bytes:
            return df.repartition(target)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str, balanced: bool = True) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return balance(df) if balanced else df
