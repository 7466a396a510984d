"""A cap on the records of every contributor, by a global sort.

The table is range sorted by (contributor, descending quality, tie) and written once with each row's
partition and index. Prefix sums of the partition counts (one row a partition) turn these into exact global
positions; the first position of a contributor, subtracted, is the row's rank, however many partitions the
contributor spans. Starts are looked up by (partition, contributor), so no task ever holds a whole contributor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.sources.shared import stored


def positions(rows: DataFrame, groups: list[str], order: list[Column], tag: str) -> DataFrame:
    """``rows`` with ``rank``, the place within the group by ``order`` from 1, and ``total``, the group's rows.

    A global range sort, whose partitions may end anywhere within a group; nulls in ``groups`` must be filtered.
    """
    whole = [F.col(g) for g in groups]
    placed = rows.repartitionByRange(*whole, *order).sortWithinPartitions(*whole, *order)
    # monotonically_increasing_id numbers the rows of a sorted partition in their order: partition in the upper bits
    placed = stored(placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_pid", F.shiftright("_at", 33).cast("int")), tag)
    runs = stored(placed.groupBy("_pid", *groups).agg(F.min("_at").alias("_first"), F.count("*").alias("_n")), f"{tag}-runs")
    counts = runs.groupBy("_pid").agg(F.sum("_n").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_pid", before.alias("_before"))  # one row a partition, so its size is bounded
    index = F.col("_first").bitwiseAND(F.lit((1 << 33) - 1))
    runs = runs.join(F.broadcast(offsets), "_pid").withColumn("_pos", F.col("_before") + index)
    # a group has at most one row a partition here
    starts = runs.groupBy(*groups).agg(F.min("_pos").alias("_start"), F.sum("_n").alias("total"))
    shift = runs.join(starts, groups).select("_pid", *groups, (F.col("_pos") - F.col("_start") - F.col("_first") + 1).alias("_shift"), "total")
    ranked = placed.join(shift, ["_pid", *groups])
    return ranked.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("rank"), "total")


def ranked_contributors(df: DataFrame, contributor: str, quality: str, tie: str) -> DataFrame:
    """(contributor, tie, quality, rank, total): every row's rank within its contributor, from 1, and the contributor's rows.

    Higher quality first, null and NaN after all numbers (alike), then the smaller tie. Rows with a null
    contributor or tie are left out. Repeated rows have ranks of their own.
    """
    value = F.col(quality).cast("double")
    number = value.isNotNull() & ~F.isnan(value)
    rows = df.where(F.col(contributor).isNotNull() & F.col(tie).isNotNull()).select(
        F.col(contributor).alias("c"), F.when(number, F.lit(0.0) - value).alias("nq"), F.col(tie).alias("t"), value.alias("q")
    )
    at = positions(rows, ["c"], [F.col("nq").asc_nulls_last(), F.col("t")], "cap")
    return at.select(F.col("c").alias(contributor), F.col("t").alias(tie), F.col("q").alias(quality), "rank", "total")


def cap_contributors(df: DataFrame, contributor: str, quality: str, tie: str, cap: int | None = None, share: float | None = None) -> DataFrame:
    """The rows of ``ranked_contributors`` that remain when each contributor keeps its best ``cap`` rows.

    With ``share`` the cap is that share of all counted rows, rounded down, at least 1; with both, the smaller.
    An empty table gives no rows.
    """
    if cap is None and share is None:
        raise ValueError("give cap, share or both")
    ranked = ranked_contributors(df, contributor, quality, tie)
    if share is not None:
        limit = max(1, int(share * ranked.count()))
        cap = limit if cap is None else min(cap, limit)
    return ranked.where(F.col("rank") <= cap)
