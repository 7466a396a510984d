"""The version rule: of several rows of one key the latest counts once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a missing version, so that a key whose versions are all missing keeps a row.
NEVER = "0001-01-01 00:00:00"


def version_of(column: str = "scraped_at") -> Column:
    """The version as a timestamp that is never null."""
    return F.coalesce(F.col(column), F.lit(NEVER).cast("timestamp"))


def latest(df: DataFrame, columns: Sequence[str], key: str = "id", version: str = "scraped_at") -> DataFrame:
    """``key`` and ``columns`` of the latest row of each key.

    Rows with a null key are ignored. Rows that tie are taken to be identical; if they are not, one of them
    is kept whole (never a mixture). Only the named columns are shuffled, pre-aggregated per partition.
    """
    row = F.max_by(F.struct(*[F.col(c) for c in columns]), version_of(version)).alias("_row")
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key)).agg(row).select(key, *[F.col("_row")[c].alias(c) for c in columns])
