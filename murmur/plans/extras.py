"""Further projections, orders and joins over the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.operators import filters as fl
from murmur.operators import text as t
from murmur.operators.order import placed
from murmur.plans.corpus import COMMENTS, CREATORS, FOLLOWERS, POSTS, comments, creators, followers, posts
from murmur.plans.registry import query
from murmur.plans.search import matching
from murmur.plans.similarity import _USABLE, IMAGE_DIM, DIM, live_vectors, usable
from murmur.plans.text import _HOLD, TERMS
from murmur.sources import settings as S

#: The columns of a post that are shown, without vectors and raw record.
SHOWN = ("platform", "url", "content", "author_name", "author_url", "author_id", "author_type", "likes", "shares", "comments", "is_repost", "scrape_source", "market", "transcript", "image_url", "image_description", "weighted_score", "creator_baseline", "x_score", "creator_spread", "x_provisional")


@query("P1_post_projection", f"SELECT id, {', '.join(SHOWN)}, epoch_ms(posted_at) AS posted_ms, epoch_ms(scraped_at) AS scraped_ms FROM {POSTS} WHERE likes >= 100")
def projection(spark: SparkSession, sf: str) -> DataFrame:
    rows = posts(spark, sf, [*SHOWN, "posted_at", "scraped_at"]).where("likes >= 100")
    return rows.select("id", *SHOWN, F.unix_millis("posted_at").alias("posted_ms"), F.unix_millis("scraped_at").alias("scraped_ms"))


@query("P5_two_phase_page", f"SELECT p.id, p.content, p.url FROM (SELECT id FROM {POSTS} WHERE market = 'ai' ORDER BY likes DESC, id LIMIT 50) s JOIN {POSTS} p USING (id)")
def two_phase(spark: SparkSession, sf: str) -> DataFrame:
    """Rank on slim columns, then fetch the page's wide ones."""
    page = posts(spark, sf, ["market", "likes"]).where("market = 'ai'").orderBy(F.desc("likes"), "id").limit(50).select("id")
    return page.join(posts(spark, sf, ["content", "url"]), "id")


@query("J1_filtered_keywords", f"SELECT id FROM {_HOLD} JOIN {POSTS} USING (id) WHERE platform IN ('linkedin', 'substack') AND likes >= 20")
def filtered_keywords(spark: SparkSession, sf: str) -> DataFrame:
    rows = matching(spark, sf, fl.parse({"platforms": "linkedin,substack", "minLikes": "20"}), ("content",))
    return t.matches(rows, "id", "content", TERMS, "any", stems=False).select("id")


@query("O3_fused_resorted", f"SELECT id, likes FROM (SELECT id, likes FROM {POSTS} ORDER BY likes DESC, id LIMIT 60) UNION SELECT id, likes FROM (SELECT id, likes FROM {POSTS} ORDER BY comments DESC, id LIMIT 60)")
def resorted(spark: SparkSession, sf: str) -> DataFrame:
    """A fused set put into the order asked for."""
    rows = posts(spark, sf, ["likes", "comments"])
    both = rows.orderBy(F.desc("likes"), "id").limit(60).union(rows.orderBy(F.desc("comments"), "id").limit(60)).distinct()
    return both.orderBy(F.desc_nulls_last("likes"), "id").select("id", "likes")


@query("O10_names_by_locale", f"SELECT platform, profile_url, display_name, row_number() OVER (PARTITION BY platform ORDER BY display_name COLLATE en NULLS LAST, profile_url) AS place FROM {CREATORS}")
def names_by_locale(spark: SparkSession, sf: str) -> DataFrame:
    """Account names of each platform in a language's order rather than that of bytes."""
    rows = placed(creators(spark, sf, ["platform", "display_name"]).select("platform", "profile_url", "display_name"), [F.col("platform"), F.collate("display_name", "UNICODE").asc_nulls_last(), F.col("profile_url")])
    starts = rows.groupBy(F.col("platform").alias("of")).agg(F.min("place").alias("start"))  # a row a platform
    return rows.join(F.broadcast(starts), F.col("platform").eqNullSafe(F.col("of"))).select("platform", "profile_url", "display_name", (F.col("place") - F.col("start") + 1).alias("place"))


@query("O12_to_comment", f"SELECT id FROM {POSTS} WHERE platform = 'linkedin' AND epoch_ms(posted_at) >= {S.NOW_MS - 30 * S.DAY_MS} ORDER BY posted_at DESC, id LIMIT 100")
def newest(spark: SparkSession, sf: str) -> DataFrame:
    rows = posts(spark, sf, ["platform", "posted_at"]).where((F.col("platform") == "linkedin") & (F.unix_millis("posted_at") >= S.NOW_MS - 30 * S.DAY_MS))
    return rows.orderBy(F.desc("posted_at"), "id").limit(100).select("id")


@query("X7_O14_transcript_queue", f"SELECT id FROM {POSTS} WHERE transcript IS NULL AND url IS NOT NULL AND CASE WHEN json_valid(media) THEN json_extract_string(media, '$.type') END = 'video' ORDER BY scraped_at, id LIMIT 25")
def transcript_queue(spark: SparkSession, sf: str) -> DataFrame:
    rows = posts(spark, sf, ["transcript", "url", "media", "scraped_at"]).where("transcript IS NULL AND url IS NOT NULL AND get_json_object(media, '$.type') = 'video'")
    return rows.orderBy("scraped_at", "id").limit(25).select("id")


@query("U7_missing_platforms", "WITH k AS (SELECT DISTINCT persona, platform FROM creators WHERE persona IS NOT NULL) SELECT p.persona, string_agg(x.platform, ',' ORDER BY x.platform) AS missing FROM (SELECT DISTINCT persona FROM k) p, (VALUES " + ", ".join(f"('{p}')" for p in S.PLATFORMS) + ") x(platform) WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.persona = p.persona AND k.platform = x.platform) GROUP BY p.persona")
def missing_platforms(spark: SparkSession, sf: str) -> DataFrame:
    from murmur.sources.tables import table

    rows = table(spark, sf, "creators").where("persona IS NOT NULL").groupBy("persona").agg(F.collect_set("platform").alias("have"))  # at most the platforms
    gone = F.array_sort(F.array_except(F.array(*[F.lit(p) for p in S.PLATFORMS]), "have"))
    return rows.select("persona", F.array_join(gone, ",").alias("missing")).where("missing <> ''")


@query("V2_V3_pair_similarity", f"""WITH v AS (SELECT id, author_id, embedding::DOUBLE[] AS x, CASE WHEN image_embedding IS NOT NULL AND len(image_embedding) = 96 AND NOT isnan(list_sum(image_embedding)) AND list_sum(list_transform(image_embedding, lambda y: abs(y))) > 0 THEN image_embedding::DOUBLE[] END AS i FROM {POSTS} WHERE {_USABLE}),
  p AS (SELECT *, lead(id) OVER w AS id2, lead(x) OVER w AS x2, lead(i) OVER w AS i2 FROM v WHERE author_id <> '' WINDOW w AS (PARTITION BY author_id ORDER BY id))
  SELECT id, id2, round(CASE WHEN i IS NOT NULL AND i2 IS NOT NULL THEN 0.75 * list_cosine_similarity(x, x2) + 0.25 * list_cosine_similarity(i, i2) ELSE list_cosine_similarity(x, x2) END, 5) AS similarity FROM p WHERE id2 IS NOT NULL""")
def pair_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """The combined similarity of each post to its author's next one: built-in array functions, no Python."""
    def cosine(a, b):
        dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
        norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
        return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))

    from murmur.operators.versions import latest
    from murmur.sources.tables import table

    rows = latest(table(spark, sf, "posts"), ["author_id", "embedding", "image_embedding"]).where(usable("embedding", DIM)).where("author_id <> ''")
    rows = rows.select("id", "author_id", F.col("embedding").alias("x"), F.when(usable("image_embedding", IMAGE_DIM), F.col("image_embedding")).alias("i"))
    w = Window.partitionBy("author_id").orderBy("id")
    p = rows.withColumns({"id2": F.lead("id").over(w), "x2": F.lead("x").over(w), "i2": F.lead("i").over(w)}).where("id2 IS NOT NULL")
    text, both = cosine(F.col("x"), F.col("x2")), F.col("i").isNotNull() & F.col("i2").isNotNull()
    return p.select("id", "id2", F.round(F.when(both, S.TEXT_WEIGHT * text + S.IMAGE_WEIGHT * cosine(F.col("i"), F.col("i2"))).otherwise(text), 5).alias("similarity"))


@query("V4_unit_vectors", f"SELECT id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) / list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 6) AS norm FROM {POSTS} WHERE {_USABLE}")
def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = live_vectors(spark, sf, "embedding").where(usable("x", DIM))
    square = lambda c: F.aggregate(F.transform(c, lambda e: e.cast("double") * e.cast("double")), F.lit(0.0), lambda s, z: s + z)
    length = F.sqrt(square(F.col("x")))
    unit = F.transform("x", lambda e: e.cast("double") / F.col("length"))
    return rows.withColumn("length", length).select("id", F.round(square(unit), 6).alias("norm"))


@query("J10_A14_series", f"SELECT author_id, platform, string_agg(followers::VARCHAR, ',' ORDER BY captured_on) AS series FROM {FOLLOWERS} GROUP BY author_id, platform")
def series(spark: SparkSession, sf: str) -> DataFrame:
    s = followers(spark, sf).groupBy("author_id", "platform").agg(F.array_sort(F.collect_list(F.struct("captured_on", "followers"))).alias("s"))  # a row a day
    return s.select("author_id", "platform", F.array_join(F.transform("s", lambda x: x["followers"].cast("string")), ",").alias("series"))


@query("F15_note_gates", f"SELECT CASE WHEN id LIKE 'substack-note-%' AND coalesce(trim(content, ' '), '') = '' AND image_url IS NULL THEN 'empty note' ELSE 'kept' END AS gate, count(*) AS posts FROM {POSTS} WHERE platform = 'substack' GROUP BY 1")
def note_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Newsletter records by what the gates say: articles and notes that hold something are kept."""
    from murmur.plans.ingest import newsletter

    return newsletter(spark, sf).groupBy(F.coalesce("error", F.lit("kept")).alias("gate")).agg(F.count("*").alias("posts"))


@query("J7_commenting_creators", f"SELECT c.author_id, count(*) AS comments FROM {COMMENTS} c WHERE c.author_id IN (SELECT author_id FROM {CREATORS} WHERE author_id IS NOT NULL) GROUP BY c.author_id")
def commenting_creators(spark: SparkSession, sf: str) -> DataFrame:
    known = creators(spark, sf, ["author_id"]).select("author_id")
    return comments(spark, sf, ["author_id"]).join(known, "author_id", "left_semi").groupBy("author_id").agg(F.count("*").alias("comments"))
