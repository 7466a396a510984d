"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of one task of a sized shuffle; a scan's statistics beyond so many bytes (1 PB) stand for an unknown size.
TASK_BYTES, UNKNOWN_BYTES = 64 << 20, 1 << 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the directory; file or folder, Spark reads both."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan in at least as many partitions as there are cores.

    For stages that compute much on few bytes. A scan that already has as many partitions, as any large table has, stays as it
    is; only one of a few small files is shuffled. ``df`` must be a scan or a projection of one.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def scanned_bytes(df: DataFrame) -> int:
    """The size of the files that a query reads, by the optimizer's statistics of its scans; what has none counts nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < UNKNOWN_BYTES)


def clustered(df: DataFrame, *keys: str, size: int | None = None) -> DataFrame:
    """Equal keys together in at least as many partitions as the session's shuffles have, also where those hold few bytes,
    and in one more for every TASK_BYTES of ``size`` (by default that of the scanned files)."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = scanned_bytes(df) if size is None else size
    return df.repartition(max(least, -(-size // TASK_BYTES)), *keys)
