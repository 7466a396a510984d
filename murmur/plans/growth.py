"""Follower and engagement growth: deltas, boards and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.operators import growth as g
from murmur.plans.corpus import CREATORS, FOLLOWERS, GROWTH, POSTS, creators, followers, post_days, posts
from murmur.plans.registry import query
from murmur.sources import settings as S

AS_OF = "2026-06-28"
AS_OF_MS = S.NOW_MS - S.DAY_MS - 1  # the last millisecond of that day
SERIES = ["author_id", "platform"]
_D = S.DAY_MS
_DAY_KEY = lambda c: F.date_format(c, "yyyy-MM-dd").alias("day")

_DELTAS = f"""(SELECT *, (ts - ts0) / {_D}.0::DOUBLE AS raw FROM (SELECT author_id, platform, captured_on, followers, epoch_ms(captured_at) AS ts, lag(followers) OVER w AS before, lag(epoch_ms(captured_at)) OVER w AS ts0
    FROM {FOLLOWERS} WINDOW w AS (PARTITION BY author_id, platform ORDER BY captured_at)) WHERE before IS NOT NULL)"""


@query("W2_follower_deltas", f"""SELECT author_id, platform, strftime(captured_on, '%Y-%m-%d') AS day, followers, followers - before AS gained, round(CASE WHEN before <> 0 THEN (followers - before) / before::DOUBLE * 100 END, 6) AS percent,
    round(CASE WHEN raw > 0 THEN raw ELSE 1 END, 6) AS gap_days, round((followers - before) / (CASE WHEN raw > 0 THEN raw ELSE 1 END), 6) AS per_day FROM {_DELTAS}""")
def deltas(spark: SparkSession, sf: str) -> DataFrame:
    d = g.follower_deltas(followers(spark, sf), SERIES)
    return d.select(*SERIES, _DAY_KEY("captured_on"), "followers", "gained", *[F.round(c, 6).alias(c) for c in ("percent", "gap_days", "per_day")])


def _window_sql(days: int, where: str = "true") -> str:
    return f"""(SELECT *, l['followers'] - b['followers'] AS gained, floor(CASE WHEN l['ts'] > b['ts'] THEN (l['ts'] - b['ts']) / {_D}.0::DOUBLE ELSE 1 END + 0.5)::BIGINT AS gap FROM (SELECT author_id, platform, count(*) AS n,
    max({{'ts': ts, 'followers': followers, 'day': captured_on}}) AS l, coalesce(max({{'ts': ts, 'followers': followers, 'day': captured_on}}) FILTER (ts <= {AS_OF_MS - days * _D}), min({{'ts': ts, 'followers': followers, 'day': captured_on}})) AS b
    FROM (SELECT *, epoch_ms(captured_at) AS ts FROM {FOLLOWERS}) WHERE ts <= {AS_OF_MS} AND {where} GROUP BY author_id, platform) WHERE n >= 2 AND l['ts'] <> b['ts'])"""


def _window(days: int):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        w = g.window_growth(followers(spark, sf), SERIES, days, AS_OF_MS)
        return w.select(*SERIES, "followers", "gained", F.round("percent", 6).alias("percent"), F.date_format("baseline_on", "yyyy-MM-dd").alias("baseline_on"), "baseline_followers", F.col("gap_days").cast("long").alias("gap_days"), "approx", "stale")

    return run


for _days in (1, 7, 30):
    query(f"W4_J11_window_{_days}", f"""SELECT author_id, platform, l['followers'] AS followers, gained, round(CASE WHEN b['followers'] <> 0 THEN gained / b['followers']::DOUBLE * 100 END, 6) AS percent, strftime(b['day'], '%Y-%m-%d') AS baseline_on,
        b['followers'] AS baseline_followers, gap AS gap_days, gap > {_days * S.APPROX_FACTOR} AS approx, ({AS_OF_MS} - l['ts']) / {_D}.0::DOUBLE > {S.STALE_DAYS} AS stale FROM {_window_sql(_days)}""")(_window(_days))


def board(spark: SparkSession, sf: str, days: int) -> DataFrame:
    """The tracked roster of one platform with its growth (null where unmeasured), posts and best score in the window."""
    roster = creators(spark, sf, ["author_id", "platform", "track_followers", "display_name"]).where("platform = 'linkedin' AND track_followers = 1 AND author_id IS NOT NULL")
    captured = followers(spark, sf).where("platform = 'linkedin'")
    series = captured.where(F.col("captured_on") >= F.date_sub(F.lit(AS_OF).cast("date"), days + 30))
    grown = g.window_growth(series, ["author_id"], days, AS_OF_MS).select("author_id", F.col("followers").alias("f"), "gained", "percent", "stale", "approx")
    spark_line = series.groupBy("author_id").agg(F.array_sort(F.collect_list(F.struct("captured_on", "followers"))).alias("s"), F.max_by("followers", "captured_at").alias("newest"))  # at most a row a day
    start, end = f"TIMESTAMP'{AS_OF} 00:00:00' - INTERVAL {days} DAY", f"TIMESTAMP'{AS_OF} 23:59:59.999'"
    stats = posts(spark, sf, ["author_id", "platform", "posted_at", "x_provisional", "x_score"]).where(f"platform = 'linkedin' AND posted_at >= {start} AND posted_at < {end}")
    stats = stats.groupBy("author_id").agg(F.count("*").alias("posts"), F.max(F.when(F.col("x_provisional") == 0, F.col("x_score"))).alias("best_x_score"))
    rows = roster.select("author_id", "display_name").join(grown, "author_id", "left").join(spark_line, "author_id", "left").join(stats, "author_id", "left")
    no = F.lit(False)
    return rows.select(
        "author_id", "display_name", F.coalesce("f", "newest", F.lit(0)).alias("followers"), "gained", "percent", F.coalesce("stale", no).alias("stale"), F.coalesce("approx", no).alias("approx"),
        F.coalesce("posts", F.lit(0)).alias("posts"), "best_x_score", F.coalesce(F.array_join(F.transform("s", lambda x: x["followers"].cast("string")), ","), F.lit("")).alias("spark"),
    )


_BOARD = f"""WITH r AS (SELECT author_id, display_name FROM {CREATORS} WHERE platform = 'linkedin' AND track_followers = 1 AND author_id IS NOT NULL), s AS (SELECT * FROM {FOLLOWERS} WHERE platform = 'linkedin' AND captured_on >= DATE '{AS_OF}' - 37),
  w AS {_window_sql(7, f"platform = 'linkedin' AND captured_on >= DATE '{AS_OF}' - 37")},
  n AS (SELECT author_id, string_agg(followers::VARCHAR, ',' ORDER BY captured_on) AS spark, max_by(followers, captured_at) AS newest FROM s GROUP BY author_id),
  t AS (SELECT author_id, count(*) AS posts, max(CASE WHEN x_provisional = 0 THEN x_score END) AS best_x_score FROM {POSTS} WHERE platform = 'linkedin' AND posted_at >= TIMESTAMPTZ '2026-06-21 00:00:00+00' AND posted_at < TIMESTAMPTZ '{AS_OF} 23:59:59.999+00' GROUP BY author_id),
  b AS (SELECT r.author_id, display_name, coalesce(l['followers'], newest, 0)::BIGINT AS followers, gained, CASE WHEN b['followers'] <> 0 THEN gained / b['followers']::DOUBLE * 100 END AS percent,
    coalesce(({AS_OF_MS} - l['ts']) / {_D}.0::DOUBLE > 2, false) AS stale, coalesce(gap > 10.5, false) AS approx, coalesce(posts, 0) AS posts, best_x_score, coalesce(spark, '') AS spark
    FROM r LEFT JOIN w USING (author_id) LEFT JOIN n USING (author_id) LEFT JOIN t USING (author_id))"""


@query("Q8_W5_leaderboard", _BOARD + """ SELECT * REPLACE (round(percent, 6) AS percent), row_number() OVER (ORDER BY gained IS NULL, gained DESC, CASE WHEN gained IS NOT NULL THEN followers END DESC, author_id, display_name) AS rank FROM b""")
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    rows = board(spark, sf, 7)
    return g.ranked(rows, "gained", more=("display_name",)).withColumn("percent", F.round("percent", 6))


@query("Q8_W5_percent_board", _BOARD + f" SELECT author_id, followers, round(percent, 6) AS percent, row_number() OVER (ORDER BY percent DESC, followers DESC, author_id) AS rank FROM b WHERE followers >= {S.FOLLOWER_FLOOR} AND percent IS NOT NULL")
def percent_board(spark: SparkSession, sf: str) -> DataFrame:
    rows = board(spark, sf, 7).where((F.col("followers") >= S.FOLLOWER_FLOOR) & F.col("percent").isNotNull())
    return g.ranked(rows, "percent").select("author_id", "followers", F.round("percent", 6).alias("percent"), "rank")


CREATOR_GROWTH = f"""WITH d AS (SELECT *, strftime(captured_on, '%Y-%m-%d') AS day FROM {_DELTAS} WHERE platform = 'linkedin'), p AS (SELECT author_id, strftime(posted_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS posts, min(id) AS only_id
    FROM {POSTS} WHERE platform = 'linkedin' AND posted_at IS NOT NULL AND author_id IS NOT NULL GROUP BY ALL)
    SELECT author_id, day, d.followers - before AS gained, coalesce(posts, 0) AS post_count, coalesce(posts, 0) > 1 AS shared, CASE WHEN posts = 1 THEN only_id END AS attributable_post_id FROM d LEFT JOIN p USING (author_id, day)"""


@query("Q9_J10_W7_creator_growth", CREATOR_GROWTH)
def creator_growth(spark: SparkSession, sf: str) -> DataFrame:
    """Growth of a day with the posts of that day; a gain is attributed only where one post stands for the day."""
    d = g.follower_deltas(followers(spark, sf).where("platform = 'linkedin'"), ["author_id"]).select("author_id", _DAY_KEY("captured_on"), "gained")
    p = posts(spark, sf, ["author_id", "platform", "posted_at"]).where("platform = 'linkedin' AND posted_at IS NOT NULL AND author_id IS NOT NULL")
    p = p.groupBy("author_id", _DAY_KEY("posted_at")).agg(F.count("*").alias("posts"), F.min("id").alias("only_id"))
    n = F.coalesce("posts", F.lit(0))
    return d.join(p, ["author_id", "day"], "left").select("author_id", "day", "gained", n.alias("post_count"), (n > 1).alias("shared"), F.when(n == 1, F.col("only_id")).alias("attributable_post_id"))


_STEPS = f"""(SELECT *, t - t0 AS gained FROM (SELECT post_id, captured_on, captured_at, likes + comments + shares AS t, lag(likes + comments + shares) OVER w AS t0, likes + 3 * comments + 5 * shares AS v, lag(likes + 3 * comments + 5 * shares) OVER w AS v0
    FROM {GROWTH} WINDOW w AS (PARTITION BY post_id ORDER BY captured_at)) WHERE t0 IS NOT NULL)"""


@query("W3_engagement_deltas", f"SELECT post_id, strftime(captured_on, '%Y-%m-%d') AS day, t AS total, gained, v - v0 AS weighted_gained, round(CASE WHEN t <> 0 THEN gained / t::DOUBLE * 100 END, 6) AS pct_of_total FROM {_STEPS}")
def engagement(spark: SparkSession, sf: str) -> DataFrame:
    d = g.engagement_deltas(post_days(spark, sf))
    return d.select("post_id", _DAY_KEY("captured_on"), "total", "gained", "weighted_gained", F.round("pct_of_total", 6).alias("pct_of_total"))


_CURVES = f"""(WITH d AS (SELECT s.*, epoch_ms(s.captured_at) AS ts, s.likes + s.comments + s.shares AS total, greatest(0, floor((epoch_ms(s.captured_at) - epoch_ms(p.posted_at)) / {_D}.0::DOUBLE * 10 + 0.5) / 10) AS age FROM {GROWTH} s JOIN {POSTS} p ON p.id = s.post_id WHERE p.posted_at IS NOT NULL),
  c AS (SELECT post_id, """ + ", ".join(f"min({{'g': abs(age - {n}), 'ts': ts, 'total': total}}) FILTER (abs(age - {n}) <= 0.5) AS s{n}" for n in (1, 2, 3)) + f""", max({{'ts': ts, 'total': total}}) AS last FROM d GROUP BY post_id),
  e AS (SELECT post_id, max({{'ts': captured_at, 'gained': gained, 'pct': CASE WHEN t <> 0 THEN gained / t::DOUBLE * 100 END}}) AS step FROM {_STEPS} GROUP BY post_id)
  SELECT p.id, p.author_id, s1['total'] AS day1, s2['total'] AS day2, s3['total'] AS day3, last['total'] AS latest_total, step['gained'] AS gained_today, coalesce(coalesce(step['pct'], 0) >= 5, false) AS still_climbing,
    round(CASE WHEN s1['total'] IS NOT NULL AND last['total'] <> 0 THEN (last['total'] - s1['total']) / last['total']::DOUBLE * 100 END, 6) AS pct_after_day1 FROM {POSTS} p LEFT JOIN c ON c.post_id = p.id LEFT JOIN e ON e.post_id = p.id WHERE p.posted_at IS NOT NULL"""


def curves(spark: SparkSession, sf: str, where: str, columns: list[str]) -> DataFrame:
    p = posts(spark, sf, ["posted_at", *columns]).where("posted_at IS NOT NULL").where(where).withColumn("posted", F.unix_millis("posted_at"))
    c = g.post_curves(p.select("id", "posted"), post_days(spark, sf))
    return p.select("id", *columns).join(c.withColumn("pct_after_day1", F.round("pct_after_day1", 6)), "id")


@query("W6_J9_J12_post_curves", f"SELECT id, day1, day2, day3, latest_total, gained_today, still_climbing, pct_after_day1 FROM {_CURVES})")
def post_curves(spark: SparkSession, sf: str) -> DataFrame:
    return curves(spark, sf, "true", [])


_ROSTER = "(SELECT author_id FROM " + CREATORS + " WHERE platform = 'linkedin' AND author_id IS NOT NULL)"
_RECENT = "posted_at >= TIMESTAMP '2026-05-29 00:00:00' AND posted_at <= TIMESTAMP '2026-06-28 23:59:59.999' AND platform = 'linkedin'"
_RECENT_SQL = "p.posted_at >= TIMESTAMPTZ '2026-05-29 00:00:00+00' AND p.posted_at <= TIMESTAMPTZ '2026-06-28 23:59:59.999+00' AND p.platform = 'linkedin'"


@query("Q10_J3_recent_post_growth", f"SELECT x.* EXCLUDE (author_id), x.author_id FROM {_CURVES} AND {_RECENT_SQL}) x JOIN {_ROSTER} r ON r.author_id = x.author_id")
def recent_post_growth(spark: SparkSession, sf: str) -> DataFrame:
    """Posts of the roster in the window with their curves; two accounts of one author id repeat its posts."""
    roster = creators(spark, sf, ["author_id", "platform"]).where("platform = 'linkedin' AND author_id IS NOT NULL").select("author_id")
    return curves(spark, sf, _RECENT, ["platform", "author_id"]).drop("platform").join(roster, "author_id")


@query("Q11_median_day1", f"SELECT x.author_id, count(*) AS posts, median(day1) AS median_day1 FROM {_CURVES} AND {_RECENT_SQL}) x JOIN {_ROSTER} r ON r.author_id = x.author_id GROUP BY x.author_id")
def median_day1(spark: SparkSession, sf: str) -> DataFrame:
    return recent_post_growth(spark, sf).groupBy("author_id").agg(F.count("*").alias("posts"), F.median("day1").alias("median_day1"))


@query("O13_moving_now", f"SELECT x.id, gained_today FROM {_CURVES} AND {_RECENT_SQL}) x ORDER BY gained_today DESC NULLS LAST, x.id LIMIT 20")
def moving_now(spark: SparkSession, sf: str) -> DataFrame:
    return curves(spark, sf, _RECENT, ["platform"]).orderBy(F.desc_nulls_last("gained_today"), "id").limit(20).select("id", "gained_today")


@query("Q14_J6_tracking_roster", f"""SELECT c.profile_url, f.followers, coalesce(n.posts, 0) AS posts_30, b.best FROM {CREATORS} c LEFT JOIN (SELECT author_id, platform, max_by(followers, captured_at) AS followers FROM {FOLLOWERS} GROUP BY ALL) f USING (author_id, platform)
    LEFT JOIN (SELECT author_id, count(*) AS posts FROM {POSTS} WHERE epoch_ms(posted_at) >= {S.NOW_MS - 30 * _D} GROUP BY ALL) n USING (author_id) LEFT JOIN (SELECT author_id, max(x_score) AS best FROM {POSTS} WHERE x_provisional = 0 AND epoch_ms(posted_at) >= {S.NOW_MS - 90 * _D} GROUP BY ALL) b USING (author_id)""")
def tracking_roster(spark: SparkSession, sf: str) -> DataFrame:
    last = followers(spark, sf).groupBy("author_id", "platform").agg(F.max_by("followers", "captured_at").alias("followers"))
    p = posts(spark, sf, ["author_id", "posted_at", "x_score", "x_provisional"]).withColumn("at", F.unix_millis("posted_at"))
    stats = p.groupBy("author_id").agg(F.count_if(F.col("at") >= S.NOW_MS - 30 * _D).alias("posts_30"), F.max(F.when((F.col("x_provisional") == 0) & (F.col("at") >= S.NOW_MS - 90 * _D), F.col("x_score"))).alias("best"))
    c = creators(spark, sf, ["author_id", "platform"])
    return c.join(last, ["author_id", "platform"], "left").join(stats, "author_id", "left").select("profile_url", "followers", F.coalesce("posts_30", F.lit(0)).alias("posts_30"), "best")
