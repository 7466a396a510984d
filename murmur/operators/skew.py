"""Joins of many rows with few rows a key, where one key may hold a third of the many rows.

The keys that hold more rows than any task should read are few by arithmetic: at most MOST_HOT keys can each hold a
MOST_HOT-th of all rows. Their side of the join is sent to every task, so their rows stay where they are; all other
keys are shuffled as usual.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with fewer rows are never hot; the most keys that may be.
LEAST_ROWS, MOST_HOT = 100_000, 2_000


def hot_keys(counts: DataFrame, n: str = "n", least: int | None = None) -> DataFrame | None:
    """The rows of ``counts`` whose ``n`` is over ``least`` (by default LEAST_ROWS) and over a MOST_HOT-th of the sum; None where there are none."""
    top = counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("total"), F.coalesce(F.max(n), F.lit(0)).alias("most")).first()
    limit = max(LEAST_ROWS if least is None else least, top["total"] // MOST_HOT)
    return counts.where(F.col(n) > limit) if top["most"] > limit else None


def skew_join(many: DataFrame, few: DataFrame, keys: Sequence[str], counts: DataFrame, n: str = "n", least: int | None = None) -> DataFrame:
    """The inner join of ``many`` with ``few`` on ``keys``.

    ``counts`` (keys, n): how many rows of ``many`` a key has; one row a key. ``few`` has a bounded number of rows a key, so the
    part of it that is broadcast is bounded too. ``many`` and ``counts`` are read twice: let them be written tables or
    scans. Null keys match nothing. With no hot key this is a plain join.
    """
    keys = list(keys)
    hot = hot_keys(counts, n, least)
    if hot is None:
        return many.join(few, keys)
    names = F.broadcast(hot.select(*keys))
    rest = many.join(names, keys, "left_anti").join(few.join(names, keys, "left_anti"), keys)
    sent = many.join(F.broadcast(few.join(names, keys, "left_semi")), keys)
    return rest.unionByName(sent)
