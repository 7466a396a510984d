"""Views of the corpus that other plans start from, and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.operators.lookup import in_order
from murmur.operators.versions import latest
from murmur.plans.registry import query
from murmur.sources.tables import table

#: The latest version of each post, in DuckDB.
POSTS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY scraped_at DESC) AS _version FROM posts) WHERE _version = 1)"
#: Snapshots without repeated rows: the last capture of a day holds.
FOLLOWERS = """(SELECT author_id, platform, captured_on, max(captured_at) AS captured_at, max_by(followers, captured_at) AS followers FROM
    (SELECT * FROM follower_snapshots WHERE followers <> 0 AND captured_on IS NOT NULL AND author_id IS NOT NULL) GROUP BY ALL)"""
GROWTH = """(SELECT post_id, captured_on, max(captured_at) AS captured_at, max_by(likes, captured_at) AS likes, max_by(comments, captured_at) AS comments,
    max_by(shares, captured_at) AS shares FROM post_snapshots WHERE captured_on IS NOT NULL GROUP BY post_id, captured_on)"""
COMMENTS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY scraped_at DESC) AS _version FROM post_comments) WHERE _version = 1)"
CREATORS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_url ORDER BY updated_at DESC, id) AS _version FROM creators) WHERE _version = 1)"


def posts(spark: SparkSession, sf: str, columns: Sequence[str]) -> DataFrame:
    """The latest version of each post: id and ``columns``."""
    return latest(table(spark, sf, "posts"), list(columns))


def comments(spark: SparkSession, sf: str, columns: Sequence[str]) -> DataFrame:
    return latest(table(spark, sf, "post_comments"), list(columns))


def followers(spark: SparkSession, sf: str) -> DataFrame:
    """(author_id, platform, captured_on, captured_at, followers): the last capture of each day; zero counts are none."""
    rows = table(spark, sf, "follower_snapshots").where("followers <> 0 AND captured_on IS NOT NULL AND author_id IS NOT NULL")
    best = F.max(F.struct("captured_at", "followers")).alias("c")
    return rows.groupBy("author_id", "platform", "captured_on").agg(best).select("author_id", "platform", "captured_on", "c.captured_at", "c.followers")


def post_days(spark: SparkSession, sf: str) -> DataFrame:
    """(post_id, captured_on, captured_at, likes, comments, shares): the last capture of each day."""
    rows = table(spark, sf, "post_snapshots").where("captured_on IS NOT NULL")
    best = F.max(F.struct("captured_at", "likes", "comments", "shares")).alias("c")
    return rows.groupBy("post_id", "captured_on").agg(best).select("post_id", "captured_on", "c.*")


def creators(spark: SparkSession, sf: str, columns: Sequence[str]) -> DataFrame:
    """One row a profile url: the last update."""
    rows = table(spark, sf, "creators").where("profile_url IS NOT NULL")
    best = F.max_by(F.struct("id", *[c for c in columns if c not in ("id", "profile_url")]), F.col("updated_at")).alias("c")
    return rows.groupBy("profile_url").agg(best).select("profile_url", "c.*")


def ms(column: str) -> Column:
    """An instant as milliseconds since 1970."""
    return F.unix_millis(F.col(column))


LOOKED_UP = ("tweet-200000050410", "activity-7000000088243", "absent", "activity-7000000130678")


@query("S1_scan", f"SELECT platform, count(*) AS posts, sum(likes)::BIGINT AS likes FROM {POSTS} WHERE likes >= 100 GROUP BY platform")
def scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = posts(spark, sf, ["platform", "likes"]).where("likes >= 100")
    return rows.groupBy("platform").agg(F.count("*").alias("posts"), F.sum("likes").alias("likes"))


@query("S2_point_lookup", f"SELECT id, platform, likes FROM {POSTS} WHERE id = 'activity-7000000088243'")
def point(spark: SparkSession, sf: str) -> DataFrame:
    one = table(spark, sf, "posts").where(F.col("id") == "activity-7000000088243")  # reaches the scan
    return latest(one, ["platform", "likes"])


@query("S3_lookup_in_order", "SELECT k.pos, p.id, p.likes FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{x}')" for i, x in enumerate(LOOKED_UP)) + f") k(pos, id) JOIN {POSTS} p ON p.id = k.id")
def several(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "posts").where(F.col("id").isin(*LOOKED_UP))
    return in_order(latest(wanted, ["likes"]), "id", LOOKED_UP).select("pos", "id", "likes")


@query("S4_existing_ids", f"SELECT DISTINCT post_id FROM post_snapshots WHERE post_id IN (SELECT id FROM {POSTS})")
def existing(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "posts").select(F.col("id").alias("post_id"))
    return table(spark, sf, "post_snapshots").select("post_id").join(ids, "post_id", "left_semi").distinct()


@query("S4_existing_urls", "SELECT DISTINCT author_url FROM posts WHERE author_url IN (SELECT profile_url FROM creators)")
def existing_urls(spark: SparkSession, sf: str) -> DataFrame:
    urls = table(spark, sf, "creators").select(F.col("profile_url").alias("author_url"))
    return table(spark, sf, "posts").select("author_url").join(urls, "author_url", "left_semi").distinct()


@query("S5_vectors", f"SELECT id, len(embedding)::BIGINT AS dim FROM {POSTS} WHERE embedding IS NOT NULL")
def stored_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "posts").withColumn("dim", F.when(F.col("embedding").isNotNull(), F.size("embedding").cast("long")))
    return latest(rows, ["dim"]).where("dim IS NOT NULL")


@query("P6_P7_engagement", f"SELECT id, likes + comments + shares AS current_total, likes + 3 * comments + 5 * shares AS weighted FROM {POSTS}")
def engagement(spark: SparkSession, sf: str) -> DataFrame:
    rows = posts(spark, sf, ["likes", "comments", "shares"])
    return rows.select("id", (F.col("likes") + F.col("comments") + F.col("shares")).alias("current_total"), (F.col("likes") + 3 * F.col("comments") + 5 * F.col("shares")).alias("weighted"))


@query("P3_comments", f"SELECT id, post_id, likes, text FROM {COMMENTS}")
def comment_rows(spark: SparkSession, sf: str) -> DataFrame:
    return comments(spark, sf, ["post_id", "likes", "text"])
