"""Runs: ledger, second looks, back-fills, profiles; input lists of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.operators import ingest as i
from murmur.operators import ledger as l
from murmur.operators import mappers as m
from murmur.plans import reports
from murmur.plans.corpus import CREATORS, GROWTH, POSTS, creators, post_days, posts
from murmur.plans.registry import query
from murmur.sources import settings as S
from murmur.sources.tables import table

_D = S.DAY_MS


@query("O8_K9_ledger", """WITH r AS (SELECT platform || '-' || strftime(scraped_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS id, platform AS platforms, count(*) FILTER (scrape_source IS DISTINCT FROM 'creator') AS keyword_raw, count(*) FILTER (scrape_source = 'creator') AS creator_raw, count(DISTINCT posts.id) AS merged_total,
    count(DISTINCT platform || coalesce(author_id, '')) AS authors, min(epoch_ms(scraped_at)) AS started_ms, max(epoch_ms(scraped_at)) AS finished_ms FROM posts WHERE scraped_at IS NOT NULL GROUP BY 1, 2)
    SELECT id, CASE WHEN merged_total = 1 THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN merged_total = 1 THEN 0 ELSE keyword_raw END AS keyword_raw, CASE WHEN merged_total = 1 THEN 0 ELSE creator_raw END AS creator_raw, CASE WHEN merged_total = 1 THEN 0 ELSE keyword_raw + creator_raw - merged_total END AS duplicates, started_ms, finished_ms FROM r ORDER BY started_ms DESC, id DESC LIMIT 20""")
def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Every day's scrape of a platform as a run of the ledger, started and finished; one with a single post counts as failed. The last 20."""
    rows = table(spark, sf, "posts").where("scraped_at IS NOT NULL")
    by = F.coalesce(F.col("scrape_source") == "creator", F.lit(False))
    runs = rows.groupBy(F.concat_ws("-", "platform", F.date_format("scraped_at", "yyyy-MM-dd")).alias("run"), F.col("platform").alias("platforms")).agg(
        F.count_if(~by).alias("keyword_raw"), F.count_if(by).alias("creator_raw"), F.countDistinct("id").alias("merged_total"), F.min("scraped_at").alias("started_at"), F.max("scraped_at").alias("finished_at")
    )
    runs = runs.withColumnRenamed("run", "id").withColumn("mode", F.lit("both"))
    none = F.lit(0).cast("long")
    results = runs.select("id", "keyword_raw", "creator_raw", "merged_total", (F.col("keyword_raw") + F.col("creator_raw") - F.col("merged_total")).alias("duplicates"), none.alias("found_in_both"), none.alias("inserted"), F.when(F.col("merged_total") == 1, "one post only").alias("error"), "finished_at")
    done = l.finished(l.started(runs), results)
    return l.recent(done).select("id", "status", "keyword_raw", "creator_raw", "duplicates", F.unix_millis("started_at").alias("started_ms"), F.unix_millis("finished_at").alias("finished_ms"))


@query("Q16_P4_profiles", f"SELECT author_id AS id, max_by(display_name, (updated_at, profile_url)) AS name, max_by(notes, (updated_at, profile_url)) AS headline, max(epoch_ms(updated_at)) AS seen_ms FROM {CREATORS} WHERE author_id IS NOT NULL AND updated_at IS NOT NULL AND platform = 'linkedin' GROUP BY author_id ORDER BY seen_ms DESC, id LIMIT 100")
def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Profile records of all accounts, mapped, kept by their last scrape and listed newest first without the raw record."""
    rows = creators(spark, sf, ["author_id", "display_name", "notes", "updated_at", "platform"]).where("author_id IS NOT NULL AND updated_at IS NOT NULL AND platform = 'linkedin'")
    raw = rows.select(F.to_json(F.struct(F.col("author_id").alias("publicIdentifier"), F.col("display_name").alias("name"), F.col("notes").alias("headline"), F.unix_millis("updated_at").alias("seen"), "profile_url")).alias("raw"))
    mapped = m.profiles(raw).withColumn("seen_ms", F.get_json_object("raw", "$.seen").cast("long")).withColumn("at", F.struct("seen_ms", F.get_json_object("raw", "$.profile_url")))
    kept = i.upsert(mapped.where(F.lit(False)), mapped, ["id"], "at")
    return kept.orderBy(F.desc("seen_ms"), "id").limit(100).select("id", "name", "headline", "seen_ms")


_STUCK = f"(SELECT DISTINCT p.author_id FROM {POSTS} p JOIN {CREATORS} c ON c.author_id = p.author_id AND c.platform = p.platform LEFT JOIN (SELECT post_id, max(epoch_ms(captured_at)) AS seen FROM post_snapshots GROUP BY post_id) s ON s.post_id = p.id WHERE p.platform = 'linkedin' AND {S.NOW_MS} - epoch_ms(p.posted_at) BETWEEN {3 * _D} AND {90 * _D} AND greatest(epoch_ms(p.scraped_at), coalesce(seen, epoch_ms(p.scraped_at))) - epoch_ms(p.posted_at) < {3 * _D})"
_LOOKED = f"(SELECT id, author_id, likes + 1 AS likes, comments, shares FROM {POSTS} WHERE platform = 'linkedin' AND author_id IN (SELECT author_id FROM {_STUCK}) UNION ALL SELECT DISTINCT 'new-' || author_id, author_id, 1, 0, 0 FROM {_STUCK})"


@query("X4_graduated", f"""WITH n AS {_LOOKED} SELECT coalesce(p.id, n.id) AS id, coalesce(n.likes, p.likes) AS likes, (SELECT count(*) FROM {GROWTH} g WHERE g.captured_on <> DATE '2026-06-30' OR g.post_id NOT IN (SELECT id FROM n)) + (SELECT count(*) FROM n) AS captures, (SELECT count(DISTINCT author_id) FROM n) AS authors
    FROM {POSTS} p FULL JOIN n ON n.id = p.id""")
def graduated(spark: SparkSession, sf: str) -> DataFrame:
    """A second look at the posts of stuck authors: here each has a like more, and each author a post that was not known."""
    numbers = ["author_id", "likes", "comments", "shares"]
    all_posts = posts(spark, sf, [*numbers, "platform"])
    stuck = reports.stuck_authors(spark, sf).select("author_id").distinct()
    again = all_posts.where("platform = 'linkedin'").join(stuck, "author_id", "left_semi").select("id", "author_id", (F.col("likes") + 1).alias("likes"), "comments", "shares")
    zero = F.lit(0).cast("long")
    fresh = stuck.select(F.concat(F.lit("new-"), "author_id").alias("id"), "author_id", (zero + 1).alias("likes"), zero.alias("comments"), zero.alias("shares"))
    after, days, authors = i.remeasured(all_posts.select("id", *numbers), again.unionByName(fresh), post_days(spark, sf), "2026-06-30", S.NOW)
    counts = days.agg(F.count("*").alias("captures")).crossJoin(authors.agg(F.count("*").alias("authors")))  # one row
    return after.select("id", "likes").crossJoin(counts)


_COLD = f"(SELECT c.profile_url, count(DISTINCT p.id) AS mature_posts FROM {CREATORS} c LEFT JOIN {POSTS} p ON p.author_id = c.author_id AND p.platform = c.platform AND {S.NOW_MS} - epoch_ms(p.posted_at) >= {30 * _D} WHERE c.author_id IS NOT NULL GROUP BY c.profile_url HAVING count(DISTINCT p.id) < 18)"


@query("X5_back_fill_plan", f"""WITH b AS (SELECT *, least(mature_posts + 3, 10) AS give, coalesce(sum(least(mature_posts + 3, 10)) OVER (ORDER BY mature_posts, profile_url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM {_COLD})
    SELECT profile_url, mature_posts, least(10, 300 - before) AS asked, least(10, 300 - before, give) AS fetched FROM b WHERE before < 300""")
def back_fill(spark: SparkSession, sf: str) -> DataFrame:
    """The plan of a back-fill of accounts with a short history, ten posts each and 300 in all; an account is taken to have three posts more than are known."""
    cold = reports.cold_start(spark, sf).withColumn("available", F.col("mature_posts") + 3)
    return i.back_fill_plan(cold, [F.col("mature_posts"), F.col("profile_url")], "available", 10, 300).select("profile_url", "mature_posts", "asked", "fetched")
