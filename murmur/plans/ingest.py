"""Ingestion: raw records to rows, merges and keyed writes, over the corpus's own tables and literal records."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.operators import ingest as i
from murmur.operators import mappers as m
from murmur.operators.versions import latest
from murmur.plans.corpus import COMMENTS, CREATORS, FOLLOWERS, GROWTH, POSTS, comments, creators, followers, post_days, posts
from murmur.plans.registry import query
from murmur.sources.tables import table

SINCE = "2026-06-01 00:00:00"
_SINCE = f"TIMESTAMPTZ '{SINCE}+00'"


def raw(spark: SparkSession, records: list[dict | str]) -> DataFrame:
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in records], "raw string")


_SEEN = ("author_id", "author_name", "author_url", "author_type", "url", "content", "likes", "shares", "comments", "posted_at", "is_repost", "image_url")
_COUNTS = ("likes", "shares", "comments")


def source_posts(spark: SparkSession, sf: str, platform: str) -> DataFrame:
    """The latest posts of a platform with ``n``, their number there, and ``iso``, their instant as text."""
    rows = posts(spark, sf, ["platform", *_SEEN]).where(F.col("platform") == platform)
    return rows.withColumn("n", F.regexp_extract("id", r"([^\-]+)$", 1)).withColumn("iso", F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def _record(**fields) -> F.Column:
    return F.to_json(F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()])).alias("raw")


def _mapped(df: DataFrame) -> DataFrame:
    return df.select("id", "url", "content", "author_id", "author_url", *_COUNTS, F.unix_millis("posted_at").alias("posted_ms"), F.col("is_repost").cast("long").alias("is_repost"), "market", F.get_json_object("media", "$.type").alias("media"), "image_url", "error")


def _mapped_sql(platform: str, id_: str, url: str, content: str, author_url: str, media: str, image: str, error: str, shares: str = "shares", comments: str = "comments", posted: str = "epoch_ms(posted_at)", repost: str = "is_repost") -> str:
    """What the mapped records of a platform's posts are; where there is an error everything else is null."""
    columns = {"id": id_, "url": url, "content": content, "author_id": "author_id", "author_url": author_url, "likes": "likes", "shares": shares, "comments": comments, "posted_ms": posted, "is_repost": repost, "market": "'ops'", "media": media, "image_url": image}
    zero = ("likes", "shares", "comments", "is_repost")
    shown = ", ".join(f"CASE WHEN e IS NULL THEN {f'coalesce({v}, 0)::BIGINT' if k in zero else v} END AS {k}" for k, v in columns.items())
    return f"SELECT {shown}, e AS error FROM (SELECT *, {error} AS e FROM (SELECT *, regexp_extract(id, '([^-]+)$', 1) AS n FROM {POSTS} WHERE platform = '{platform}'))"


_URN = "coalesce(nullif(regexp_extract(url, '(?:activity|ugcPost|share)[-:](\\d+)', 1), ''), n)"
_IMAGE = "CASE WHEN image_url <> '' THEN 'image' END"
_SHOWN = "nullif(image_url, '')"


@query("M1_network_posts", _mapped_sql("linkedin", _URN, f"'https://www.links.example/feed/update/urn:li:activity:' || {_URN} || '/'", "content", "author_url", _IMAGE, _SHOWN, "NULL::VARCHAR"))
def network(spark: SparkSession, sf: str) -> DataFrame:
    """The network's posts written as source records and mapped back."""
    r = source_posts(spark, sf, "linkedin")
    author = F.struct(F.col("author_name").alias("name"), F.col("author_id").alias("universalName"), F.col("author_url").alias("linkedinUrl"), F.col("author_type").alias("type"))
    reposted = F.when(F.col("is_repost") == 1, F.struct(F.lit("x").alias("name")))
    raw_ = r.select(_record(id="n", linkedinUrl="url", content="content", author=author, engagement=F.struct(*_COUNTS), postedAt=F.struct(F.col("iso").alias("date")), repostedBy=reposted, postImages=F.array(F.struct(F.col("image_url").alias("url")))))
    return _mapped(m.network_posts(raw_, "ops", "links.example"))


_DATED = "CASE WHEN posted_at IS NULL THEN 'bad date' END"


@query("M2_micro_blog_posts", _mapped_sql("twitter", "'tweet-' || n", "url", "content", "'https://chirp.example/' || nullif(author_id, '')", "NULL::VARCHAR", "NULL::VARCHAR", _DATED, posted="epoch_ms(posted_at) // 1000 * 1000"))
def micro_blog(spark: SparkSession, sf: str) -> DataFrame:
    r = source_posts(spark, sf, "twitter")
    made = F.date_format("posted_at", "EEE MMM dd HH:mm:ss Z yyyy")
    raw_ = r.select(_record(id="n", url="url", text="content", author=F.struct(F.col("author_id").alias("userName")), createdAt=made, likeCount="likes", retweetCount="shares", replyCount="comments", isRetweet=F.col("is_repost") == 1))
    return _mapped(m.micro_blog_posts(raw_, "ops", "chirp.example"))


_NOTE = "id LIKE 'substack-note-%'"


@query("M3_M4_newsletter", _mapped_sql("substack", "CASE WHEN {0} THEN 'substack-note-' ELSE 'substack-' END || n".format(_NOTE), f"CASE WHEN {_NOTE} THEN 'https://letters.example/@' || nullif(author_id, '') || '/note/c-' || n ELSE url END",
    f"CASE WHEN {_NOTE} THEN CASE WHEN trim(content, ' ') <> '' THEN content END ELSE nullif(content, '') END", f"CASE WHEN {_NOTE} THEN 'https://letters.example/@' || nullif(author_id, '') ELSE author_url END", _IMAGE, _SHOWN,
    f"CASE WHEN {_NOTE} AND coalesce(trim(content, ' '), '') = '' AND image_url IS NULL THEN 'empty note' END", shares=f"CASE WHEN {_NOTE} THEN 0 ELSE shares END", comments=f"CASE WHEN {_NOTE} THEN 0 ELSE comments END", repost=f"CASE WHEN {_NOTE} THEN is_repost ELSE 0 END"))
def newsletter(spark: SparkSession, sf: str) -> DataFrame:
    r = source_posts(spark, sf, "substack").withColumn("note", F.col("id").like("substack-note-%"))
    when = lambda c: F.when(F.col("note"), F.col(c))
    unless = lambda c: F.when(~F.col("note"), F.coalesce(c, F.lit("")) if c == "author_url" else F.col(c))
    raw_ = r.select(_record(
        id="n", type=F.when(F.col("note"), "note"), kind=F.when(F.col("note") & (F.col("is_repost") == 1), "restack"), url="url", title=unless("content"), body=when("content"), authorHandle=when("author_id"), authorName=when("author_name"),
        publicationHandle=unless("author_id"), publicationUrl=F.when(~F.col("note"), F.col("author_url")), publishedAt=unless("iso"), createdAt=when("iso"), reactionCount="likes", restackCount="shares", commentCount="comments", coverImage=unless("image_url"), attachmentUrls=F.when(F.col("note") & F.col("image_url").isNotNull(), F.array("image_url")),
    ))
    return _mapped(m.newsletter_posts(raw_.where("raw IS NOT NULL"), "ops", "letters.example"))


@query("M5_photo_posts", _mapped_sql("instagram", "'instagram-' || n", "coalesce(url, 'https://www.pics.example/p/' || n || '/')", "content", "'https://www.pics.example/' || nullif(author_id, '') || '/'", _IMAGE, _SHOWN, "NULL::VARCHAR", shares="0", repost="0"))
def photo(spark: SparkSession, sf: str) -> DataFrame:
    r = source_posts(spark, sf, "instagram")
    raw_ = r.select(_record(shortCode="n", url="url", caption="content", ownerUsername="author_id", ownerFullName="author_name", likesCount="likes", commentsCount="comments", timestamp="iso", displayUrl="image_url"))
    return _mapped(m.photo_posts(raw_, "ops", "pics.example"))


@query("M6_profiles", f"""SELECT author_id AS id, nullif(display_name, '') AS name, market AS location, 7::BIGINT AS followers, CASE WHEN json_valid(tags) AND json_array_length(tags) > 0 THEN replace(tags, '", "', '","') END AS skills FROM {CREATORS} WHERE author_id IS NOT NULL""")
def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts written as profile records and mapped back; the lists are carried as they are."""
    rows = creators(spark, sf, ["author_id", "display_name", "market", "tags"]).where("author_id IS NOT NULL")
    tags = F.from_json("tags", "array<string>")
    out = m.profiles(rows.select(_record(publicIdentifier="author_id", name="display_name", location=F.struct(F.col("market").alias("linkedinText")), followerCount=F.lit(7), skills=tags)))
    return out.select("id", "name", "location", "followers", "skills")


_TOP = f"(SELECT * FROM {COMMENTS} WHERE parent_comment_id IS NULL AND regexp_matches(id, '^[0-9]+$'))"


@query("M7_comments", f"SELECT regexp_extract(post_id, '([^-]+)$', 1) AS post_id, id, NULL::VARCHAR AS parent_comment_id, text, likes FROM {_TOP} UNION ALL SELECT regexp_extract(t.post_id, '([^-]+)$', 1), r.id, t.id, r.text, r.likes FROM {COMMENTS} r JOIN {_TOP} t ON r.parent_comment_id = t.id")
def comment_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Comments with their replies inside, written as source records and flattened again; a reply takes its parent's post."""
    rows = comments(spark, sf, ["post_id", "parent_comment_id", "text", "likes"]).withColumn("likes", F.coalesce("likes", F.lit(0)))
    post = F.regexp_extract("post_id", r"([^\-]+)$", 1)
    urn = F.concat(F.lit("https://links.example/x?commentUrn=urn%3Ali%3Acomment%3A%28activity%3A"), post, F.lit("%2C"), F.col("id"), F.lit("%29"))
    reply = F.struct("id", F.col("text").alias("commentary"), F.struct("likes").alias("engagement"))
    replies = rows.where("parent_comment_id IS NOT NULL").groupBy(F.col("parent_comment_id").alias("id")).agg(F.collect_list(reply).alias("replies"))  # the replies of one comment
    top = rows.where(F.col("parent_comment_id").isNull() & F.col("id").rlike("^[0-9]+$")).join(replies, "id", "left")
    numbered = post.rlike("^[0-9]+$")
    raw_ = top.select(_record(linkedinUrl=F.when(numbered, urn), id="id", postId=post, commentary="text", engagement=F.struct("likes"), replies="replies"))
    return m.comments(raw_).select("post_id", "id", "parent_comment_id", "text", "likes")


@query("M8_raw_data", f"SELECT id, json_extract_string(raw_data, '$.id') AS source_id, json_extract(raw_data, '$.likeCount')::BIGINT AS likes FROM {POSTS} WHERE raw_data IS NOT NULL AND json_valid(raw_data)")
def raw_data(spark: SparkSession, sf: str) -> DataFrame:
    """The stored raw record of each post, read with the fields that are known."""
    rows = posts(spark, sf, ["raw_data"]).where(F.try_parse_json("raw_data").isNotNull())
    return rows.select("id", F.get_json_object("raw_data", "$.id").alias("source_id"), F.get_json_object("raw_data", "$.likeCount").cast("long").alias("likes"))


_RUNS = "(SELECT id, scrape_source, scraped_at FROM posts WHERE id <> '')"


@query("U1_W9_merge_sources", f"""WITH r AS (SELECT id, CASE WHEN scrape_source = 'creator' THEN 1 ELSE 0 END AS run FROM {_RUNS}) SELECT id, CASE WHEN count(DISTINCT run) = 2 THEN 'both' WHEN min(run) = 0 THEN 'keyword' ELSE 'creator' END AS source FROM r GROUP BY id""")
def merge_sources(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "posts").select("id", "scrape_source", "scraped_at")
    by_creator = F.coalesce(F.col("scrape_source") == "creator", F.lit(False))
    return i.merged_sources(rows.where(~by_creator), rows.where(by_creator), "id", "scraped_at").select("id", "source")


@query("A23_merge_report", f"WITH r AS (SELECT id, CASE WHEN scrape_source = 'creator' THEN 1 ELSE 0 END AS run FROM {_RUNS}), g AS (SELECT id, count(*) AS n, count(DISTINCT run) AS runs FROM r GROUP BY id) SELECT sum(n)::BIGINT AS raw, count(*) AS merged, (sum(n) - count(*))::BIGINT AS duplicates, count(*) FILTER (runs = 2) AS found_in_both FROM g")
def merge_report(spark: SparkSession, sf: str) -> DataFrame:
    run = F.coalesce(F.col("scrape_source") == "creator", F.lit(False))
    g = table(spark, sf, "posts").where("id <> ''").groupBy("id").agg(F.count("*").alias("n"), F.countDistinct(run).alias("runs"))
    return g.agg(F.sum("n").alias("raw"), F.count("*").alias("merged"), (F.sum("n") - F.count("*")).alias("duplicates"), F.count_if(F.col("runs") == 2).alias("found_in_both"))


def _split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "posts").select("id", "url", "likes", "scraped_at")
    old = F.col("scraped_at") < F.lit(SINCE).cast("timestamp")
    return latest(rows.where(old), ["url", "likes", "scraped_at"]), rows.where(~old)


@query("K1_J19_insert_ignore", f"""WITH t AS (SELECT DISTINCT id, url FROM posts WHERE scraped_at < {_SINCE}), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY scraped_at) AS r FROM (SELECT DISTINCT id, url, scraped_at FROM posts WHERE scraped_at >= {_SINCE})) WHERE r = 1),
  l AS (SELECT id, max_by(url, scraped_at) AS url FROM posts WHERE scraped_at < {_SINCE} GROUP BY id), u AS (SELECT *, row_number() OVER (PARTITION BY coalesce(url, 'null:' || id) ORDER BY scraped_at, id) AS k FROM b)
  SELECT id FROM u WHERE k = 1 AND id NOT IN (SELECT id FROM t) AND (url IS NULL OR url NOT IN (SELECT url FROM l WHERE url IS NOT NULL))""")
def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    target, batch = _split(spark, sf)
    return i.insert_ignore(target, batch.distinct(), "id", "url", "scraped_at").select("id")


@query("K2_update_only", f"SELECT l.id, coalesce(n.likes, l.likes) AS likes FROM (SELECT id, max_by(likes, scraped_at) AS likes FROM posts WHERE scraped_at < {_SINCE} GROUP BY id) l LEFT JOIN (SELECT id, max_by(likes, scraped_at) AS likes FROM posts WHERE scraped_at >= {_SINCE} GROUP BY id) n USING (id)")
def update_only(spark: SparkSession, sf: str) -> DataFrame:
    target, batch = _split(spark, sf)
    return i.update_only(target, latest(batch, ["likes"]), "id", ["likes"]).select("id", "likes")


@query("K3_X1_followers_upsert", f"SELECT author_id, platform, strftime(captured_on, '%Y-%m-%d') AS day, followers FROM {FOLLOWERS}")
def followers_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Captures of the last month written over those before, one row a series and day."""
    rows = table(spark, sf, "follower_snapshots").where("followers <> 0 AND captured_on IS NOT NULL AND author_id IS NOT NULL").select("author_id", "platform", "captured_on", "captured_at", "followers")
    key = ["author_id", "platform", "captured_on"]
    late = F.col("captured_at") >= F.lit(SINCE).cast("timestamp")
    target = i.first_rows(rows.where(~late), key, [F.desc("captured_at")])
    return i.upsert(target, rows.where(late), key, "captured_at").select("author_id", "platform", F.date_format("captured_on", "yyyy-MM-dd").alias("day"), "followers")


@query("K4_coalesced_upsert", f"SELECT coalesce(n.id, l.id) AS id, coalesce(n.url, l.url) AS url, coalesce(n.likes, l.likes) AS likes FROM (SELECT id, arg_max_null(url, scraped_at) AS url, max_by(likes, scraped_at) AS likes FROM posts WHERE scraped_at < {_SINCE} GROUP BY id) l FULL JOIN (SELECT id, arg_max_null(url, scraped_at) AS url, max_by(likes, scraped_at) AS likes FROM posts WHERE scraped_at >= {_SINCE} GROUP BY id) n ON n.id = l.id")
def coalesced_upsert(spark: SparkSession, sf: str) -> DataFrame:
    target, batch = _split(spark, sf)
    return i.upsert_coalesced(target, batch, "id", ["url", "likes"], "scraped_at")


@query("K5_insert_missing", f"SELECT DISTINCT author_id, platform FROM {FOLLOWERS} UNION SELECT DISTINCT author_id, platform FROM creators WHERE author_id IS NOT NULL")
def insert_missing(spark: SparkSession, sf: str) -> DataFrame:
    target = followers(spark, sf).select("author_id", "platform").distinct()
    batch = table(spark, sf, "creators").where("author_id IS NOT NULL").select("author_id", "platform")
    return i.insert_missing(target, batch, ["author_id", "platform"], "author_id")


@query("K6_U6_delete", f"SELECT id FROM {POSTS} WHERE id NOT IN (SELECT post_id FROM post_snapshots WHERE post_id IS NOT NULL)")
def deleted(spark: SparkSession, sf: str) -> DataFrame:
    return i.delete(table(spark, sf, "posts").select("id").distinct(), table(spark, sf, "post_snapshots").select(F.col("post_id").alias("id")), "id")


@query("K7_Q26_redacted_export", "SELECT id, likes, NULL::VARCHAR AS raw_data FROM posts")
def export(spark: SparkSession, sf: str) -> DataFrame:
    return i.redacted(table(spark, sf, "posts").select("id", "likes", "raw_data"), ["raw_data"])


@query("J18_requested_missing", f"SELECT DISTINCT author_id FROM creators WHERE track_followers = 1 AND author_id IS NOT NULL AND author_id NOT IN (SELECT author_id FROM {FOLLOWERS})")
def requested_missing(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "creators").where("track_followers = 1 AND author_id IS NOT NULL").select("author_id").distinct()
    return wanted.join(followers(spark, sf).select("author_id"), "author_id", "left_anti")


@query("F20_comment_selection", f"""WITH c AS (SELECT post_id, count(DISTINCT id) AS stored FROM post_comments GROUP BY post_id) SELECT p.id, CASE WHEN platform <> 'linkedin' THEN 'refused' WHEN coalesce(stored, 0) >= comments THEN 'up to date' ELSE 'scrape' END AS choice FROM {POSTS} p LEFT JOIN c ON c.post_id = p.id""")
def comment_selection(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "post_comments").groupBy(F.col("post_id").alias("id")).agg(F.countDistinct("id").alias("stored"))
    rows = posts(spark, sf, ["platform", "comments"]).join(stored, "id", "left")
    return rows.select("id", F.when(F.col("platform") != "linkedin", "refused").when(F.coalesce("stored", F.lit(0)) >= F.col("comments"), "up to date").otherwise("scrape").alias("choice"))


@query("O15_batches", f"""WITH r AS (SELECT id, platform, length(coalesce(content, '')) AS n FROM {POSTS}), s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY platform ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 270000 AS stretch FROM r),
  p AS (SELECT *, (row_number() OVER (PARTITION BY platform, stretch ORDER BY id) - 1) // 100 AS part FROM s) SELECT platform, stretch::BIGINT AS stretch, part::BIGINT AS part, count(*) AS rows, sum(n)::BIGINT AS chars FROM p GROUP BY platform, stretch, part""")
def work_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = posts(spark, sf, ["platform", "content"]).select("id", "platform", F.length(F.coalesce("content", F.lit(""))).alias("n"))
    b = i.batches(rows, "platform", ["id"], "n", 100, 270_000)
    return b.groupBy("platform", F.col("batch._stretch").alias("stretch"), F.col("batch.part").alias("part")).agg(F.count("*").alias("rows"), F.sum("n").alias("chars"))


@query("X1_daily_capture", f"SELECT post_id, strftime(captured_on, '%Y-%m-%d') AS day, likes, comments, shares FROM {GROWTH}")
def daily_capture(spark: SparkSession, sf: str) -> DataFrame:
    """One row a post and day, the last capture of the day, from a stream over the table's files."""
    from murmur.streaming.capture import captured_table

    rows = captured_table(spark, sf, "post_snapshots", ["post_id", "captured_on"], "captured_at", day="captured_on")
    return rows.select("post_id", F.date_format("captured_on", "yyyy-MM-dd").alias("day"), "likes", "comments", "shares")
