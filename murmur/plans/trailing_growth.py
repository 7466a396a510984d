"""Followers gained over trailing periods, for every series and every day of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.operators import rolling
from murmur.plans.registry import query
from murmur.sources.tables import clustered, table

SERIES = ["author_id", "platform"]
PERIODS = (7, 30)


def captures(snapshots: DataFrame) -> DataFrame:
    """(author_id, platform, captured_on, followers): one count a day, the latest capture of the day.

    Rows with null or 0 followers or without a day are no captures; of captures of one instant the higher counts.
    """
    rows = snapshots.where((F.col("followers") != 0) & F.col("captured_on").isNotNull())
    return rows.groupBy(*SERIES, "captured_on").agg(F.max(F.struct("captured_at", "followers")).alias("c")).select(*SERIES, "captured_on", F.col("c.followers").alias("followers"))


def gains(days: DataFrame) -> DataFrame:
    """(series, captured_on, gain): the count minus the last earlier one, 0 on the first day."""
    before = F.lag("followers").over(Window.partitionBy(*SERIES).orderBy("captured_on"))
    return days.select(*SERIES, "captured_on", F.coalesce(F.col("followers") - before, F.lit(0)).alias("gain"))


def trailing_gains(snapshots: DataFrame) -> DataFrame:
    """(series, captured_on, total_7, average_7, total_30, average_30) for every day from the first to the last capture."""
    daily = gains(captures(snapshots))
    nodes = rolling.tree(daily, SERIES, "captured_on", "gain", max(PERIODS))
    span = daily.groupBy(*SERIES).agg(F.min("captured_on").alias("a"), F.max("captured_on").alias("b"))
    span = clustered(span, *SERIES)  # few bytes that become many days: in as many tasks as shuffles have
    dates = span.select(*SERIES, F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("captured_on"))
    return rolling.trailing(nodes, dates, SERIES, "captured_on", PERIODS, repeated=False)


_DAILY = """WITH c AS (SELECT author_id, platform, captured_on, max_by(followers, captured_at) AS followers FROM follower_snapshots
    WHERE followers <> 0 AND captured_on IS NOT NULL GROUP BY ALL),
  g AS (SELECT author_id, platform, captured_on, coalesce(followers - lag(followers) OVER (PARTITION BY author_id, platform ORDER BY captured_on), 0) AS gain FROM c),
  d AS (SELECT author_id, platform, unnest(generate_series(min(captured_on), max(captured_on), INTERVAL 1 DAY))::DATE AS day FROM g GROUP BY author_id, platform),
  f AS (SELECT d.author_id, d.platform, d.day, coalesce(g.gain, 0) AS gain FROM d LEFT JOIN g ON d.author_id IS NOT DISTINCT FROM g.author_id
    AND d.platform IS NOT DISTINCT FROM g.platform AND d.day = g.captured_on),
  t AS (SELECT author_id, platform, strftime(day, '%Y-%m-%d') AS captured_day,
    sum(gain) OVER (PARTITION BY author_id, platform ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)::BIGINT AS total_7,
    sum(gain) OVER (PARTITION BY author_id, platform ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)::BIGINT AS total_30 FROM f) """


@query("p5_rolling", _DAILY + "SELECT author_id, platform, captured_day, total_7, round(total_7 / 7.0::DOUBLE, 6) AS average_7, total_30, round(total_30 / 30.0::DOUBLE, 6) AS average_30 FROM t")
def p5_rolling(spark: SparkSession, sf: str) -> DataFrame:
    out = trailing_gains(table(spark, sf, "follower_snapshots"))
    return out.select(*SERIES, F.date_format("captured_on", "yyyy-MM-dd").alias("captured_day"), "total_7", F.round("average_7", 6).alias("average_7"), "total_30", F.round("average_30", 6).alias("average_30"))


@query("p5_found", _DAILY + "SELECT author_id, platform, captured_day FROM t WHERE total_7 < 0 AND total_30 > 0")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    out = trailing_gains(table(spark, sf, "follower_snapshots")).where("total_7 < 0 AND total_30 > 0")
    return out.select(*SERIES, F.date_format("captured_on", "yyyy-MM-dd").alias("captured_day"))
