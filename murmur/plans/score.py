"""Outlier scores recomputed over the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.operators import score
from murmur.plans.corpus import POSTS, post_days, posts
from murmur.plans.registry import query
from murmur.sources import settings as S


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Posts with the instant of their last measurement: the later of the scrape and the latest snapshot."""
    rows = posts(spark, sf, ["author_id", "likes", "comments", "shares", "posted_at", "scraped_at"])
    last = post_days(spark, sf).groupBy(F.col("post_id").alias("id")).agg(F.max(F.unix_millis("captured_at")).alias("seen"))
    at = F.unix_millis("scraped_at")
    return rows.join(last, "id", "left").select("id", "author_id", score.weighted().alias("ws"), F.unix_millis("posted_at").alias("posted"), F.greatest(at, F.coalesce("seen", at)).alias("measured"))


def badge(z: Column) -> Column:
    """The tone of a score."""
    return F.when(z >= S.RARE_Z, "green").when(z >= S.NOTABLE_Z, "amber").when(z <= S.LOW_Z, "red").otherwise("gray")


_HISTORY = f"""h AS (SELECT p.id, p.author_id, p.likes + 3 * p.comments + 5 * p.shares AS ws, epoch_ms(p.posted_at) AS posted, greatest(epoch_ms(p.scraped_at), coalesce(s.seen, epoch_ms(p.scraped_at))) AS measured
    FROM {POSTS} p LEFT JOIN (SELECT post_id, max(epoch_ms(captured_at)) AS seen FROM post_snapshots WHERE captured_on IS NOT NULL GROUP BY post_id) s ON s.post_id = p.id WHERE p.author_id <> '')"""
_DAY = S.DAY_MS
_SCORES = f"""WITH {_HISTORY}, d AS (SELECT *, ln(1 + ws) AS lg, (measured - posted) / {_DAY}.0::DOUBLE AS age FROM h WHERE posted IS NOT NULL),
  a AS (SELECT t.id, t.ws, t.lg, t.age, list({{'at': p.posted, 'id': p.id, 'lg': p.lg}} ORDER BY p.posted, p.id) FILTER (p.id IS NOT NULL) AS s FROM d t LEFT JOIN d p ON p.author_id = t.author_id AND p.posted < t.posted
    AND p.posted > t.posted - {S.SPREAD_DAYS * _DAY} AND p.age >= 3 GROUP BY t.id, t.ws, t.lg, t.age),
  b AS (SELECT a.*, d.posted, list_transform(list_filter(s, lambda x: x['at'] > d.posted - {S.LEVEL_DAYS * _DAY}), lambda x: x['lg']) AS l, list_transform(s, lambda x: x['lg']) AS g FROM a JOIN d USING (id)),
  c AS (SELECT *, list_median(l[greatest(len(l) - 9, 1):len(l)]) AS level, list_transform(range(11, len(g) + 1), lambda i: g[i] - list_median(g[i - 10:i - 1])) AS r FROM b),
  e AS (SELECT *, age >= 1 AND len(l) >= 5 AND len(g) >= 15 AND len(r) >= 8 AS ok, greatest(1.4826 * list_median(list_transform(r, lambda x: abs(x - list_median(r)))), 0.15) AS spread FROM c)
  SELECT h.id, h.ws::BIGINT AS weighted_score, round(CASE WHEN ok THEN exp(level) - 1 END, 6) AS creator_baseline, round(CASE WHEN ok THEN spread END, 6) AS creator_spread,
    round(CASE WHEN ok AND exp(level) - 1 > 0 THEN h.ws / (exp(level) - 1) END, 6) AS x_factor, round(CASE WHEN ok THEN (lg - level) / spread END, 6) AS x_score, coalesce((age < 3)::BIGINT, 0) AS x_provisional
  FROM h LEFT JOIN e USING (id)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return score.scores(history(spark, sf))


@query("W1_Q17_xfactor", _SCORES)
def xfactor(spark: SparkSession, sf: str) -> DataFrame:
    rounded = [F.round(c, 6).alias(c) for c in ("creator_baseline", "creator_spread", "x_factor", "x_score")]
    return scored(spark, sf).select("id", F.col("weighted_score").cast("long").alias("weighted_score"), *rounded, "x_provisional")


@query("W1_notable", f"SELECT id, x_score, CASE WHEN x_score >= 2.5 THEN 'green' ELSE 'amber' END AS tone FROM ({_SCORES}) WHERE x_score >= 1.5 ORDER BY x_score DESC, id LIMIT 50")
def notable(spark: SparkSession, sf: str) -> DataFrame:
    rows = xfactor(spark, sf).where(F.col("x_score") >= S.NOTABLE_Z)
    return rows.orderBy(F.desc("x_score"), "id").limit(50).select("id", "x_score", badge(F.col("x_score")).alias("tone"))


@query("X3_touched_authors", f"SELECT * FROM ({_SCORES}) WHERE id IN (SELECT id FROM {POSTS} WHERE author_id IN (SELECT author_id FROM {POSTS} WHERE epoch_ms(scraped_at) >= {S.NOW_MS - 2 * _DAY}))")
def touched(spark: SparkSession, sf: str) -> DataFrame:
    """Only authors with a recent scrape are scored again."""
    all_posts = history(spark, sf)
    recent = posts(spark, sf, ["author_id", "scraped_at"]).where(F.unix_millis("scraped_at") >= S.NOW_MS - 2 * _DAY).select("author_id").distinct()
    rounded = [F.round(c, 6).alias(c) for c in ("creator_baseline", "creator_spread", "x_factor", "x_score")]
    return score.scores(all_posts.join(recent, "author_id", "left_semi")).select("id", F.col("weighted_score").cast("long").alias("weighted_score"), *rounded, "x_provisional")
