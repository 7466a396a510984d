"""Filtered, sorted and paged search over posts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.operators import filters as fl
from murmur.operators import text as t
from murmur.operators.order import placed
from murmur.plans.corpus import POSTS, creators, posts
from murmur.plans.facets import _authors_sql, author_facet
from murmur.plans.registry import query
from murmur.sources.settings import DAY_MS, NOW_MS
from murmur.sources.tables import table

_NO_NAN = "CASE WHEN isnan({0}) THEN NULL ELSE {0} END"
_CASES: dict[str, tuple[dict[str, str], str]] = {
    "F1_platforms": ({"platforms": "twitter,substack"}, "platform IN ('twitter', 'substack')"),
    "F3_authors": ({"authors": "mira-solvane, pripasz-bapasz-1gu"}, "author_id IN ('mira-solvane', 'pripasz-bapasz-1gu')"),
    "F4_min_likes_shares": ({"minLikes": "200", "minShares": "3"}, "likes >= 200 AND shares >= 3"),
    "F5_min_x_factor": ({"minXFactor": "0"}, "x_factor >= 0"),
    "F5_min_x_score": ({"minXScore": "1.5"}, "x_score >= 1.5"),
    "F6_no_provisional": ({"includeProvisional": "false"}, "x_provisional = 0"),
    "F7_market": ({"market": "ops"}, "market = 'ops'"),
    "F8_custom_dates": ({"dateFrom": "2026-03-01", "dateTo": "2026-04-15"}, "strftime(posted_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%gZ') BETWEEN '2026-03-01' AND '2026-04-15'"),
    "F9_timeframe": ({"timeframe": "month"}, f"epoch_ms(posted_at) >= {NOW_MS - 30 * DAY_MS}"),
    "F17_broken_query": ({"platform": "myspace", "minLikes": "many", "sort": "best", "timeframe": "eon"}, "true"),
}


def matching(spark: SparkSession, sf: str, f: fl.PostFilters, more: tuple[str, ...] = ()) -> DataFrame:
    """The latest versions of posts that the filters keep (keywords apart)."""
    rows = posts(spark, sf, [*fl.FILTERED, *[c for c in more if c not in fl.FILTERED]])
    return rows.where(fl.predicate(f, NOW_MS))


def _filtered(asked: dict[str, str]):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return matching(spark, sf, fl.parse(asked)).select("id")

    return run


for _name, (_asked, _where) in _CASES.items():
    query(_name, f"SELECT id FROM {POSTS} WHERE {_where}")(_filtered(_asked))


@query("F10_both_vectors", f"SELECT id FROM {POSTS} WHERE embedding IS NOT NULL AND image_embedding IS NOT NULL")
def both_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "posts").withColumn("a", F.col("embedding").isNotNull()).withColumn("b", F.col("image_embedding").isNotNull())
    from murmur.operators.versions import latest

    return latest(rows, ["a", "b"]).where("a AND b").select("id")


@query("F11_creator_filters", "SELECT DISTINCT profile_url FROM creators WHERE platform = 'linkedin' AND track_followers = 1 AND tags LIKE '%\"watch\"%'")
def creator_filters(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.from_json("tags", "array<string>")
    rows = table(spark, sf, "creators").where((F.col("platform") == "linkedin") & (F.col("track_followers") == 1) & F.array_contains(tags, "watch"))
    return rows.select("profile_url").distinct()


@query("F12_missing_transcripts", f"SELECT id FROM {POSTS} WHERE platform = 'instagram' AND transcript IS NULL AND url IS NOT NULL AND CASE WHEN json_valid(media) THEN json_extract_string(media, '$.type') END = 'video'")
def missing_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    rows = posts(spark, sf, ["platform", "transcript", "url", "media"])
    return rows.where("platform = 'instagram' AND transcript IS NULL AND url IS NOT NULL AND get_json_object(media, '$.type') = 'video'").select("id")


@query("F13_needs_enrichment", f"SELECT id FROM {POSTS} WHERE embedding IS NULL OR (image_url IS NOT NULL AND image_embedding IS NULL) ORDER BY scraped_at, id LIMIT 200")
def needs_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    from murmur.operators.versions import latest

    need = F.expr("embedding IS NULL OR (image_url IS NOT NULL AND image_embedding IS NULL)")
    rows = latest(table(spark, sf, "posts").withColumn("need", need), ["need", "scraped_at"])
    return rows.where("need").orderBy("scraped_at", "id").limit(200).select("id")


@query("F14_language_gate", r"SELECT doc_id FROM documents WHERE text IS NULL OR len(regexp_replace(text, '[^\p{L}]', '', 'g')) = 0 OR len(regexp_replace(regexp_replace(text, '[^\p{L}]', '', 'g'), '\p{Latin}', '', 'g')) <= 0.3 * len(regexp_replace(text, '[^\p{L}]', '', 'g'))")
def language_gate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(fl.mostly_latin(F.col("text"))).select("doc_id")


@query("F21_author_contains", f"SELECT DISTINCT author_id FROM {POSTS} WHERE contains(lower(coalesce(author_name, '')), 'sol') OR contains(lower(coalesce(author_id, '')), 'sol')")
def author_contains(spark: SparkSession, sf: str) -> DataFrame:
    rows = posts(spark, sf, ["author_id", "author_name"])
    near = [F.lower(F.coalesce(c, F.lit(""))).contains("sol") for c in (F.col("author_name"), F.col("author_id"))]
    return rows.where(near[0] | near[1]).select("author_id").distinct()


_PAGES: dict[str, tuple[dict[str, str], str]] = {
    "O1_recent": ({}, "posted_at DESC NULLS LAST, id"),
    "O1_likes": ({"sort": "likes"}, "likes DESC NULLS LAST, id"),
    "O1_xfactor": ({"sort": "xfactor"}, _NO_NAN.format("x_factor") + " DESC NULLS LAST, id"),
    "O1_xscore": ({"sort": "xscore"}, _NO_NAN.format("x_score") + " DESC NULLS LAST, id"),
}


def _paged(asked: dict[str, str]):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        f = fl.parse(asked | {"page": "2", "pageSize": "40"})
        return fl.page(matching(spark, sf, f), f).select("id", "likes")

    return run


for _name, (_asked, _order) in _PAGES.items():
    query(_name, f"SELECT id, likes FROM {POSTS} ORDER BY {_order} LIMIT 40 OFFSET 40")(_paged(_asked))

_Q1 = {"platform": "linkedin", "minLikes": "50", "timeframe": "3months", "sort": "xscore", "pageSize": "25"}


@query("Q1_search_posts", f"""WITH f AS (SELECT * FROM {POSTS} WHERE platform = 'linkedin' AND likes >= 50 AND epoch_ms(posted_at) >= {NOW_MS - 90 * DAY_MS})
    SELECT id, author_id, likes, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 25 AS has_more FROM f ORDER BY {_NO_NAN.format("x_score")} DESC NULLS LAST, id LIMIT 25""")
def search_posts(spark: SparkSession, sf: str) -> DataFrame:
    f = fl.parse(_Q1)
    rows = matching(spark, sf, f)
    total = rows.agg(F.count("*").alias("total"))  # one row
    shown = fl.page(rows, f).select("id", "author_id", "likes")
    return shown.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > (f.page - 1) * f.page_size + f.page_size)


def authors_of(spark: SparkSession, sf: str, f: fl.PostFilters) -> DataFrame:
    """Q5: the authors under all filters but the list of authors itself, keywords included."""
    free = replace(f, authors=())
    rows = matching(spark, sf, free, ("author_name", *(["content"] if f.keywords else [])))
    if f.keywords:
        held = t.matches(rows, "id", "content", f.keywords, f.match)
        rows = rows.join(held.select("id"), "id", "left_semi")
    return author_facet(rows, table(spark, sf, "creators"))


@query("Q5_authors_of_search", _authors_sql(f"(SELECT * FROM {POSTS} WHERE platform = 'linkedin' AND likes >= 50 AND epoch_ms(posted_at) >= {NOW_MS - 90 * DAY_MS})"))
def authors_of_search(spark: SparkSession, sf: str) -> DataFrame:
    """The list of authors that a search names does not shrink its facet."""
    return authors_of(spark, sf, fl.parse(_Q1 | {"authors": "mira-solvane"}))


@query("O4_candidates", f"SELECT id FROM {POSTS} WHERE embedding IS NOT NULL ORDER BY likes DESC, id LIMIT 400")
def candidates(spark: SparkSession, sf: str) -> DataFrame:
    from murmur.operators.versions import latest

    rows = latest(table(spark, sf, "posts").withColumn("has", F.col("embedding").isNotNull()), ["has", "likes"])
    return rows.where("has").orderBy(F.desc("likes"), "id").limit(400).select("id")


@query("O7_Q18_recent_viral", f"SELECT id, x_score, likes FROM {POSTS} WHERE platform = 'linkedin' AND epoch_ms(posted_at) >= {NOW_MS - 3 * DAY_MS} AND x_score IS NOT NULL ORDER BY x_score DESC, likes DESC, id LIMIT 10")
def recent_viral(spark: SparkSession, sf: str) -> DataFrame:
    rows = posts(spark, sf, ["platform", "posted_at", "x_score", "likes"]).where((F.col("platform") == "linkedin") & (F.unix_millis("posted_at") >= NOW_MS - 3 * DAY_MS) & F.col("x_score").isNotNull())
    return rows.orderBy(F.desc("x_score"), F.desc("likes"), "id").limit(10).select("id", "x_score", "likes")


@query("O9_names_no_case", "SELECT profile_url, row_number() OVER (ORDER BY lower(display_name) NULLS LAST, profile_url) AS place FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_url ORDER BY updated_at DESC) AS v FROM creators) WHERE v = 1) WHERE platform = 'substack'")
def names_in_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = creators(spark, sf, ["platform", "display_name"]).where("platform = 'substack'")
    return placed(rows, [F.lower("display_name").asc_nulls_last(), F.col("profile_url")]).select("profile_url", "place")
