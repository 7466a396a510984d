"""Lookups by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Keys of a caller's list that are sent to every task; longer lists are joined.
MOST_SENT = 100_000


def in_order(df: DataFrame, key: str, values: Sequence) -> DataFrame:
    """The rows of the given keys with ``pos``, the place in the caller's list; absent keys have no row.

    The list comes from the caller; up to MOST_SENT keys it is broadcast.
    """
    if not values:
        return df.where(F.lit(False)).withColumn("pos", F.lit(0).cast("long"))
    wanted = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(v) for v in values])).alias("pos", key))
    wanted = wanted.withColumn("pos", F.col("pos").cast("long"))
    return df.join(F.broadcast(wanted) if len(values) <= MOST_SENT else wanted, key)
