"""Growth of followers and of posts' engagement between captures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.operators.order import placed
from murmur.sources import settings as S

DAY = float(S.DAY_MS)


def half_up(x: Column) -> Column:
    """Rounding with halves up, also below zero."""
    return F.floor(x + 0.5)


def gap_days(earlier: Column, later: Column) -> Column:
    """Days between two instants (ms); 1 where they do not advance."""
    days = (later - earlier) / DAY
    return F.when(days > 0, days).otherwise(F.lit(1.0))


def percent(gained: Column, base: Column) -> Column:
    """The change in percent; null on a base of zero."""
    return F.when(base != 0, gained / base * 100)


def follower_deltas(captures: DataFrame, series: Sequence[str]) -> DataFrame:
    """(series, captured_on, followers, gained, percent, gap_days, per_day) of each capture but the first."""
    w = Window.partitionBy(*series).orderBy("captured_at")
    at = F.unix_millis("captured_at")
    rows = captures.withColumn("before", F.lag("followers").over(w)).withColumn("at", at).withColumn("at_before", F.lag(at).over(w)).where("before IS NOT NULL")
    gained, gap = F.col("followers") - F.col("before"), gap_days(F.col("at_before"), F.col("at"))
    return rows.select(*series, "captured_on", "followers", gained.alias("gained"), percent(gained, F.col("before")).alias("percent"), gap.alias("gap_days"), (gained / gap).alias("per_day"))


def window_growth(captures: DataFrame, series: Sequence[str], days: int, as_of_ms: int) -> DataFrame:
    """Growth over the last ``days`` up to the end of a day (its last millisecond, ``as_of_ms``).

    The baseline is the newest capture at or before the window's start, else the oldest. A series with fewer than two
    captures, or whose baseline is its latest, has no row.
    """
    start = as_of_ms - days * S.DAY_MS
    rows = captures.withColumn("at", F.unix_millis("captured_at")).where(F.col("at") <= as_of_ms)
    one = F.struct("at", "followers", "captured_on")
    g = rows.groupBy(*series).agg(F.count("*").alias("n"), F.max(one).alias("last"), F.coalesce(F.max(F.when(F.col("at") <= start, one)), F.min(one)).alias("base"))
    g = g.where((F.col("n") >= 2) & (F.col("last.at") != F.col("base.at")))
    gained = F.col("last.followers") - F.col("base.followers")
    gap = half_up(gap_days(F.col("base.at"), F.col("last.at")))
    stale = gap_days(F.col("last.at"), F.lit(as_of_ms)) > S.STALE_DAYS
    return g.select(
        *series, F.col("last.followers").alias("followers"), gained.alias("gained"), percent(gained, F.col("base.followers")).alias("percent"), F.col("base.captured_on").alias("baseline_on"),
        F.col("base.followers").alias("baseline_followers"), gap.alias("gap_days"), (gap > days * S.APPROX_FACTOR).alias("approx"), stale.alias("stale"),
    )


def ranked(rows: DataFrame, metric: str, name: str = "rank", more: Sequence[str] = ()) -> DataFrame:
    """Ranks by the metric, unmeasured rows last; ties by followers, then author and ``more``; unmeasured ones by author only."""
    m = F.col(metric)
    return placed(rows, [m.isNull(), m.desc(), F.when(m.isNotNull(), F.col("followers")).desc(), F.col("author_id"), *[F.col(c) for c in more]], name)


def total(prefix: str = "") -> Column:
    return F.col(prefix + "likes") + F.col(prefix + "comments") + F.col(prefix + "shares")


def engagement_deltas(days: DataFrame) -> DataFrame:
    """(post_id, captured_on, total, gained, weighted_gained, pct_of_total) of each capture but the first; losses are kept."""
    w = Window.partitionBy("post_id").orderBy("captured_at")
    weight = F.col("likes") * S.WEIGHT_LIKES + F.col("comments") * S.WEIGHT_COMMENTS + F.col("shares") * S.WEIGHT_SHARES
    rows = days.withColumn("total", total()).withColumn("weight", weight)
    rows = rows.withColumn("gained", F.col("total") - F.lag("total").over(w)).withColumn("weighted_gained", F.col("weight") - F.lag("weight").over(w)).where("gained IS NOT NULL")
    return rows.select("post_id", "captured_on", "captured_at", "total", "gained", "weighted_gained", F.when(F.col("total") != 0, F.col("gained") / F.col("total") * 100).alias("pct_of_total"))


def age_days(posted: Column, captured: Column) -> Column:
    """Days from one instant to another to one decimal, halves up; none below zero."""
    raw = (captured - posted) / DAY
    return F.when(raw > 0, half_up(raw * 10) / 10).otherwise(F.lit(0.0))


def post_curves(posts: DataFrame, days: DataFrame) -> DataFrame:
    """Totals nearest to days 1, 2 and 3 (half a day off at most, the earlier on a tie), the latest, and whether it still climbs.

    ``posts``: id, posted (ms). Posts without a capture have nulls and do not climb.
    """
    d = days.withColumn("at", F.unix_millis("captured_at")).withColumn("total", total())
    d = d.join(posts.select(F.col("id").alias("post_id"), "posted"), "post_id")
    gap = lambda n: F.abs(age_days(F.col("posted"), F.col("at")) - n)
    slots = [F.min(F.when(gap(n) <= S.SLOT_DAYS, F.struct(gap(n).alias("g"), F.col("at"), F.col("total")))).alias(f"s{n}") for n in (1, 2, 3)]
    last = d.groupBy("post_id").agg(F.max(F.struct("at", "total")).alias("last"), *slots)
    step = engagement_deltas(days).groupBy("post_id").agg(F.max(F.struct("captured_at", "gained", "pct_of_total")).alias("step"))
    rows = posts.join(last.withColumnRenamed("post_id", "id"), "id", "left").join(step.withColumnRenamed("post_id", "id"), "id", "left")
    latest, day1 = F.col("last.total"), F.col("s1.total")
    return rows.select(
        "id", day1.alias("day1"), F.col("s2.total").alias("day2"), F.col("s3.total").alias("day3"), latest.alias("latest_total"), F.col("step.gained").alias("gained_today"),
        F.coalesce(F.coalesce(F.col("step.pct_of_total"), F.lit(0.0)) >= S.CLIMBING_PERCENT, F.lit(False)).alias("still_climbing"),
        F.when(day1.isNotNull() & (latest != 0), (latest - day1) / latest * 100).alias("pct_after_day1"),
    )
