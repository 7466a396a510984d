"""Places in a global order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.sources.shared import stored


def placed(rows: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place from 1 in a global order, without bringing them into one task.

    A range sort, written once; prefix sums of the partitions' row counts (one row a partition) make places in a partition global.
    """
    placed_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # monotonically_increasing_id numbers the rows of a sorted partition in their order: partition in the upper bits
    placed_ = stored(placed_.withColumn("_at", F.monotonically_increasing_id()), "order")
    pid = F.shiftright("_at", 33).cast("int").alias("_pid")
    counts = placed_.groupBy(pid).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_pid", before.alias("_before"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed_.withColumn("_pid", pid).join(F.broadcast(offsets), "_pid").select(*rows.columns, (F.col("_before") + within + 1).alias(name))


def running(rows: DataFrame, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before them in a global order; partitions of a range sort are summed first."""
    put = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "running")
    pid = F.shiftright("_at", 33).cast("int")
    sums = put.groupBy(pid.alias("_pid")).agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("_pid", before.alias("_before"))  # one row a partition
    within = F.coalesce(F.sum(value).over(Window.partitionBy("_pid").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return put.withColumn("_pid", pid).withColumn("_in", within).join(F.broadcast(offsets), "_pid").select(*rows.columns, (F.col("_before") + F.col("_in")).alias(name))
