"""Corpus statistics and facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.operators.versions import latest
from murmur.plans.corpus import COMMENTS, CREATORS, FOLLOWERS, POSTS, comments, creators, followers, post_days, posts
from murmur.plans.registry import query
from murmur.sources.settings import PLATFORMS
from murmur.sources.tables import table


@query("A1_count", f"SELECT count(*) AS total FROM {POSTS} WHERE likes >= 10")
def count_posts(spark: SparkSession, sf: str) -> DataFrame:
    return posts(spark, sf, ["likes"]).where("likes >= 10").agg(F.count("*").alias("total"))


@query("A2_Q6_platforms", f"""SELECT platform, count(*) AS posts, count(DISTINCT author_id) AS authors, sum(likes)::BIGINT AS likes, min(epoch_ms(posted_at)) AS first_ms,
    max(epoch_ms(posted_at)) AS last_ms FROM {POSTS} GROUP BY platform""")
def platforms(spark: SparkSession, sf: str) -> DataFrame:
    rows = posts(spark, sf, ["platform", "author_id", "likes", "posted_at"])
    at = F.unix_millis("posted_at")
    return rows.groupBy("platform").agg(F.count("*").alias("posts"), F.countDistinct("author_id").alias("authors"), F.sum("likes").alias("likes"), F.min(at).alias("first_ms"), F.max(at).alias("last_ms"))


@query("A3_markets", f"SELECT market, count(*) AS posts FROM {POSTS} WHERE market IS NOT NULL GROUP BY market")
def markets(spark: SparkSession, sf: str) -> DataFrame:
    return posts(spark, sf, ["market"]).where("market IS NOT NULL").groupBy("market").agg(F.count("*").alias("posts"))


@query("A4_coverage", f"SELECT count(*) AS posts, count(embedding) AS embedded, count(image_embedding) AS image_embedded, count(nullif(transcript, '')) AS transcribed FROM {POSTS}")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    have = {"embedded": F.col("embedding").isNotNull(), "image_embedded": F.col("image_embedding").isNotNull(), "transcribed": F.col("transcript") != ""}
    rows = latest(table(spark, sf, "posts").select("id", "scraped_at", *[e.alias(n) for n, e in have.items()]), list(have))
    return rows.agg(F.count("*").alias("posts"), *[F.count_if(n).alias(n) for n in have])


@query("A5_Q7_scrape_status", "SELECT p.platform, max(epoch_ms(scraped_at)) AS last_ms, count(id) AS posts FROM (VALUES " + ", ".join(f"('{p}')" for p in (*PLATFORMS, "podcast")) + f") p(platform) LEFT JOIN {POSTS} x ON x.platform = p.platform GROUP BY p.platform")
def scrape_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = posts(spark, sf, ["platform", "scraped_at"]).groupBy("platform").agg(F.max(F.unix_millis("scraped_at")).alias("last_ms"), F.count("*").alias("posts"))
    known = spark.createDataFrame([(p,) for p in (*PLATFORMS, "podcast")], "platform string")
    return known.join(rows, "platform", "left").select("platform", "last_ms", F.coalesce("posts", F.lit(0)).cast("long").alias("posts"))


def _authors_sql(rows: str) -> str:
    return f"""WITH n AS (SELECT author_id, author_name, platform, count(*) AS c FROM {rows} WHERE author_id IS NOT NULL AND author_id <> '' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY (coalesce(regexp_matches(author_name, '\\s|[A-Z]'), false)) DESC, c DESC, coalesce(len(author_name), 0) DESC,
    author_name NULLS LAST, platform) AS r, sum(c) OVER (PARTITION BY author_id) AS posts FROM n),
    k AS (SELECT author_id, max({{'u': coalesce(updated_at, TIMESTAMPTZ '1970-01-01 00:00:00+00'), 'id': id, 'a': avatar_url, 'p': persona}}) AS m FROM creators WHERE author_id IS NOT NULL GROUP BY author_id)
    SELECT r.author_id, r.author_name, r.platform, r.posts::BIGINT AS posts, k.m['a'] AS avatar, k.m['p'] AS persona, k.author_id IS NOT NULL AS is_core FROM r LEFT JOIN k ON k.author_id = r.author_id WHERE r = 1"""


def author_facet(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """(author_id, author_name, platform, posts, avatar, persona, is_core): the authors of ``rows``, each by its most human name.

    Avatar and persona are those of the account last updated; tracked accounts are core, whatever the platform.
    """
    names = rows.where("author_id IS NOT NULL AND author_id <> ''").groupBy("author_id", "author_name", "platform").agg(F.count("*").alias("c"))
    human = F.coalesce(F.col("author_name").rlike(r"\s|[A-Z]"), F.lit(False))
    key = F.struct((~human).alias("a"), (-F.col("c")).alias("b"), (-F.coalesce(F.length("author_name"), F.lit(0))).alias("d"), F.col("author_name").isNull().alias("e"), F.col("author_name"), F.col("platform"))
    best = names.groupBy("author_id").agg(F.min(key).alias("k"), F.sum("c").alias("posts"))
    last = F.max_by(F.struct("avatar_url", "persona"), F.struct(F.coalesce("updated_at", F.lit("1970-01-01").cast("timestamp")), F.col("id"))).alias("m")
    core = accounts.where("author_id IS NOT NULL").groupBy("author_id").agg(last)
    return best.join(core, "author_id", "left").select("author_id", "k.author_name", "k.platform", "posts", F.col("m.avatar_url").alias("avatar"), F.col("m.persona").alias("persona"), F.col("m").isNotNull().alias("is_core"))


@query("A6_Q5_authors", _authors_sql(POSTS))
def authors(spark: SparkSession, sf: str) -> DataFrame:
    """The author facet of all posts."""
    return author_facet(posts(spark, sf, ["author_id", "author_name", "platform"]), table(spark, sf, "creators"))


@query("A8_latest_day", f"SELECT strftime(max(captured_on), '%Y-%m-%d') AS day, count(*) AS captures FROM {FOLLOWERS}")
def latest_day(spark: SparkSession, sf: str) -> DataFrame:
    return followers(spark, sf).agg(F.date_format(F.max("captured_on"), "yyyy-MM-dd").alias("day"), F.count("*").alias("captures"))


@query("A9_table_counts", "SELECT (SELECT count(*) FROM follower_snapshots) AS follower_rows, (SELECT count(*) FROM post_snapshots) AS post_rows, (SELECT count(*) FROM keywords) AS keyword_rows")
def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda t, a: table(spark, sf, t).agg(F.count("*").alias(a))
    return n("follower_snapshots", "follower_rows").crossJoin(n("post_snapshots", "post_rows")).crossJoin(n("keywords", "keyword_rows"))  # one row each


@query("A10_comments_per_post", f"SELECT post_id, count(*) AS comments, count(DISTINCT author_id) AS people FROM {COMMENTS} GROUP BY post_id")
def comments_per_post(spark: SparkSession, sf: str) -> DataFrame:
    return comments(spark, sf, ["post_id", "author_id"]).groupBy("post_id").agg(F.count("*").alias("comments"), F.countDistinct("author_id").alias("people"))


@query("A11_prolific_authors", f"SELECT author_id, count(*) AS posts FROM {POSTS} WHERE author_id <> '' GROUP BY author_id HAVING count(*) >= 20")
def prolific(spark: SparkSession, sf: str) -> DataFrame:
    return posts(spark, sf, ["author_id"]).where("author_id <> ''").groupBy("author_id").agg(F.count("*").alias("posts")).where("posts >= 20")


@query("A12_median_likes", f"SELECT platform, median(likes) AS median_likes FROM {POSTS} GROUP BY platform")
def median_likes(spark: SparkSession, sf: str) -> DataFrame:
    return posts(spark, sf, ["platform", "likes"]).groupBy("platform").agg(F.median("likes").alias("median_likes"))


@query("A13_mad_likes", f"WITH m AS (SELECT *, median(likes) OVER (PARTITION BY platform) AS m FROM {POSTS}) SELECT platform, median(abs(likes - m)) AS mad FROM m GROUP BY platform")
def mad_likes(spark: SparkSession, sf: str) -> DataFrame:
    rows = posts(spark, sf, ["platform", "likes"])
    middle = rows.groupBy("platform").agg(F.median("likes").alias("m"))  # a row a platform
    return rows.join(F.broadcast(middle), "platform").groupBy("platform").agg(F.median(F.abs(F.col("likes") - F.col("m"))).alias("mad"))


@query("A14_Q15_keywords", "SELECT market, string_agg(term, ',' ORDER BY term) AS terms, count(*) AS n FROM keywords GROUP BY market")
def keywords(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "keywords").groupBy("market").agg(F.array_join(F.array_sort(F.collect_list("term")), ",").alias("terms"), F.count("*").alias("n"))


@query("A15_tags", "SELECT DISTINCT unnest(json_extract_string(tags, '$[*]')) AS tag FROM creators WHERE json_valid(tags) AND json_type(tags) = 'ARRAY'")
def tags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "creators").select(F.explode(F.from_json("tags", "array<string>")).alias("tag")).where("tag IS NOT NULL").distinct()


@query("A17_creators_by_platform", "SELECT p.platform, count(c.profile_url) AS accounts FROM (VALUES " + ", ".join(f"('{p}')" for p in (*PLATFORMS, "podcast")) + f") p(platform) LEFT JOIN {CREATORS} c ON c.platform = p.platform GROUP BY p.platform")
def creators_by_platform(spark: SparkSession, sf: str) -> DataFrame:
    n = creators(spark, sf, ["platform"]).groupBy("platform").agg(F.count("*").alias("n"))
    known = spark.createDataFrame([(p,) for p in (*PLATFORMS, "podcast")], "platform string")
    return known.join(n, "platform", "left").select("platform", F.coalesce("n", F.lit(0)).cast("long").alias("accounts"))


@query("A18_shared_personas", "SELECT persona, count(DISTINCT profile_url) AS accounts FROM creators WHERE persona IS NOT NULL GROUP BY persona HAVING count(DISTINCT profile_url) > 1")
def shared_personas(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "creators").where("persona IS NOT NULL").groupBy("persona").agg(F.countDistinct("profile_url").alias("accounts")).where("accounts > 1")


@query("A21_U4_authors", "SELECT DISTINCT author_id FROM posts WHERE author_id IS NOT NULL AND author_id <> ''")
def author_list(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "posts").select("author_id").where("author_id IS NOT NULL AND author_id <> ''").distinct()


@query("A22_tracking_coverage", f"SELECT count(*) AS creators, count(s.author_id) AS measured FROM (SELECT DISTINCT author_id, platform FROM {CREATORS} WHERE author_id IS NOT NULL) c LEFT JOIN (SELECT DISTINCT author_id, platform FROM {FOLLOWERS}) s USING (author_id, platform)")
def tracking_coverage(spark: SparkSession, sf: str) -> DataFrame:
    roster = creators(spark, sf, ["author_id", "platform"]).where("author_id IS NOT NULL").select("author_id", "platform").distinct()
    seen = followers(spark, sf).select("author_id", "platform").distinct().withColumn("seen", F.lit(1))
    return roster.join(seen, ["author_id", "platform"], "left").agg(F.count("*").alias("creators"), F.count("seen").alias("measured"))


@query("A24_capture_report", f"""WITH r AS (SELECT DISTINCT author_id, platform FROM {CREATORS} WHERE author_id IS NOT NULL AND track_followers = 1), d AS (SELECT author_id, platform,
    max(followers) AS f FROM follower_snapshots WHERE captured_on = DATE '2026-06-28' GROUP BY ALL) SELECT count(*) AS requested, count(*) FILTER (f > 0) AS captured,
    count(*) FILTER (d.author_id IS NOT NULL AND coalesce(f, 0) = 0) AS skipped, count(*) FILTER (d.author_id IS NULL) AS missing FROM r LEFT JOIN d USING (author_id, platform)""")
def capture_report(spark: SparkSession, sf: str) -> DataFrame:
    roster = creators(spark, sf, ["author_id", "platform", "track_followers"]).where("author_id IS NOT NULL AND track_followers = 1").select("author_id", "platform").distinct()
    day = table(spark, sf, "follower_snapshots").where("captured_on = DATE '2026-06-28'").groupBy("author_id", "platform").agg(F.max("followers").alias("f"), F.lit(True).alias("there"))
    both = roster.join(day, ["author_id", "platform"], "left")
    there = F.coalesce("there", F.lit(False))
    return both.agg(F.count("*").alias("requested"), F.count_if(F.col("f") > 0).alias("captured"), F.count_if(there & (F.coalesce("f", F.lit(0)) == 0)).alias("skipped"), F.count_if(~there).alias("missing"))


@query("A7_posts_in_window", f"""SELECT author_id, count(*) AS posts, max(CASE WHEN x_provisional = 0 THEN x_score END) AS best FROM {POSTS}
    WHERE posted_at >= TIMESTAMPTZ '2026-06-23 00:00:00+00' AND posted_at < TIMESTAMPTZ '2026-06-29 23:59:59.999+00' AND author_id <> '' GROUP BY author_id""")
def posts_in_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = posts(spark, sf, ["author_id", "x_provisional", "x_score", "posted_at"]).where("posted_at >= TIMESTAMP '2026-06-23 00:00:00' AND posted_at < TIMESTAMP '2026-06-29 23:59:59.999' AND author_id <> ''")
    return rows.groupBy("author_id").agg(F.count("*").alias("posts"), F.max(F.when(F.col("x_provisional") == 0, F.col("x_score"))).alias("best"))


@query("Q12_O11_comment_threads", f"""WITH c AS (SELECT id, post_id, parent_comment_id, coalesce(epoch_ms(commented_at), -1) AS ts FROM {COMMENTS}),
    j AS (SELECT c.*, p.id AS root, coalesce(p.ts, c.ts) AS root_at, coalesce(p.id, c.id) AS root_id FROM c LEFT JOIN c p ON p.id = c.parent_comment_id AND p.post_id = c.post_id)
    SELECT post_id, id, (root IS NOT NULL)::BIGINT AS depth, row_number() OVER (PARTITION BY post_id ORDER BY root_at, root_id, root IS NOT NULL, ts, id) AS place FROM j""")
def comment_threads(spark: SparkSession, sf: str) -> DataFrame:
    """A reply stands under its stored parent, an orphan reply stays at the top level; oldest first."""
    c = comments(spark, sf, ["post_id", "parent_comment_id", "commented_at"]).select("id", "post_id", "parent_comment_id", F.coalesce(F.unix_millis("commented_at"), F.lit(-1)).alias("at"))
    p = c.select(F.col("id").alias("pid"), F.col("post_id").alias("ppost"), F.col("at").alias("pat"))
    j = c.join(p, (F.col("parent_comment_id") == F.col("pid")) & (F.col("post_id") == F.col("ppost")), "left")
    order = [F.coalesce("pat", "at"), F.coalesce("pid", "id"), F.col("pid").isNotNull(), F.col("at"), F.col("id")]
    return j.select("post_id", "id", F.col("pid").isNotNull().cast("long").alias("depth"), F.row_number().over(Window.partitionBy("post_id").orderBy(*order)).cast("long").alias("place"))


@query("A16_person_pivot", """WITH k AS (SELECT DISTINCT persona AS person, platform, profile_url FROM creators WHERE persona IS NOT NULL)
    SELECT person, """ + ", ".join(f"count(*) FILTER (platform = '{p}') AS {p}" for p in PLATFORMS) + ", count(DISTINCT platform) AS platform_count FROM k GROUP BY person")
def person_pivot(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "creators").where("persona IS NOT NULL").select(F.col("persona").alias("person"), "platform", "profile_url").distinct()
    wide = rows.groupBy("person").pivot("platform", list(PLATFORMS)).count().na.fill(0, list(PLATFORMS))
    n = rows.groupBy("person").agg(F.countDistinct("platform").alias("platform_count"))
    return wide.join(n, "person")
