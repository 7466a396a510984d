"""Reports: selections of authors, the research digest, the daily performance log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.functions import scalars as sc
from murmur.operators import similarity as v
from murmur.operators.versions import latest
from murmur.plans import growth
from murmur.plans import similarity as sim
from murmur.plans.corpus import CREATORS, POSTS, creators, posts
from murmur.plans.registry import query
from murmur.sources import settings as S
from murmur.sources.shared import stored
from murmur.sources.tables import table

OWN = "mira-solvane"
_D = S.DAY_MS


@query("Q19_J4_stuck_authors", f"""SELECT p.author_id, min(c.profile_url) AS profile_url, count(DISTINCT p.id) AS stuck_posts FROM {POSTS} p JOIN {CREATORS} c ON c.author_id = p.author_id AND c.platform = p.platform LEFT JOIN (SELECT post_id, max(epoch_ms(captured_at)) AS seen FROM post_snapshots GROUP BY post_id) s ON s.post_id = p.id
    WHERE p.platform = 'linkedin' AND {S.NOW_MS} - epoch_ms(p.posted_at) BETWEEN {3 * _D} AND {90 * _D} AND greatest(epoch_ms(p.scraped_at), coalesce(seen, epoch_ms(p.scraped_at))) - epoch_ms(p.posted_at) < {3 * _D} GROUP BY p.author_id""")
def stuck_authors(spark: SparkSession, sf: str) -> DataFrame:
    """Authors with posts that are old enough to be measured as mature and never were."""
    seen = table(spark, sf, "post_snapshots").groupBy(F.col("post_id").alias("id")).agg(F.max(F.unix_millis("captured_at")).alias("seen"))
    at, scraped = F.unix_millis("posted_at"), F.unix_millis("scraped_at")
    p = posts(spark, sf, ["author_id", "platform", "posted_at", "scraped_at"]).where((F.col("platform") == "linkedin") & (S.NOW_MS - at).between(3 * _D, 90 * _D))
    p = p.join(seen, "id", "left").where(F.greatest(scraped, F.coalesce("seen", scraped)) - at < S.MATURE_DAYS * _D)
    roster = creators(spark, sf, ["author_id", "platform"]).where("author_id IS NOT NULL").drop("id")
    return p.join(roster, ["author_id", "platform"]).groupBy("author_id").agg(F.min("profile_url").alias("profile_url"), F.countDistinct("id").alias("stuck_posts"))


@query("Q20_J5_cold_start", f"SELECT c.profile_url, count(DISTINCT p.id) AS mature_posts FROM {CREATORS} c LEFT JOIN {POSTS} p ON p.author_id = c.author_id AND p.platform = c.platform AND {S.NOW_MS} - epoch_ms(p.posted_at) >= {30 * _D} WHERE c.author_id IS NOT NULL GROUP BY c.profile_url HAVING count(DISTINCT p.id) < 18")
def cold_start(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts with too few old posts to score new ones; the age is a condition of the join, so accounts without posts stay."""
    c = creators(spark, sf, ["author_id", "platform"]).where("author_id IS NOT NULL").drop("id")
    old = posts(spark, sf, ["author_id", "platform", "posted_at"]).where(S.NOW_MS - F.unix_millis("posted_at") >= 30 * _D)
    return c.join(old, ["author_id", "platform"], "left").groupBy("profile_url").agg(F.countDistinct("id").alias("mature_posts")).where("mature_posts < 18")


@query("Q21_J21_inactive", f"""WITH s AS (SELECT author_id, count(*) AS posts, max(epoch_ms(posted_at)) AS last_ms, count(*) FILTER (epoch_ms(posted_at) >= {S.NOW_MS - 90 * _D}) AS recent FROM {POSTS} WHERE author_id <> '' GROUP BY author_id)
    SELECT profile_url, coalesce(posts, 0) AS posts, last_ms, coalesce(recent, 0) AS recent, coalesce(recent, 0) > 0 AS keep FROM {CREATORS} c LEFT JOIN s ON s.author_id = c.author_id""")
def inactive(spark: SparkSession, sf: str) -> DataFrame:
    at = F.unix_millis("posted_at")
    s = posts(spark, sf, ["author_id", "posted_at"]).where("author_id <> ''").groupBy("author_id").agg(F.count("*").alias("posts"), F.max(at).alias("last_ms"), F.count_if(at >= S.NOW_MS - 90 * _D).alias("recent"))
    rows = creators(spark, sf, ["author_id"]).join(s, "author_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("profile_url", n("posts"), "last_ms", n("recent"), (F.coalesce("recent", F.lit(0)) > 0).alias("keep"))


@query("Q13_creators", f"SELECT profile_url, display_name FROM {CREATORS} WHERE platform = 'linkedin' AND tags LIKE '%\"core\"%' ORDER BY added_at DESC, profile_url LIMIT 100")
def creator_list(spark: SparkSession, sf: str) -> DataFrame:
    rows = creators(spark, sf, ["platform", "display_name", "tags", "added_at"]).where((F.col("platform") == "linkedin") & F.array_contains(F.from_json("tags", "array<string>"), "core"))
    return rows.orderBy(F.desc("added_at"), "profile_url").limit(100).select("profile_url", "display_name")


#: How much each kind of engagement counts for a goal (fixed values).
GOALS = {"grow": (0.5, 0.2, 0.3), "sell": (0.3, 0.2, 0.5), "balanced": (0.6, 0.3, 0.1)}
LENSES = ("xfactor", "likes", "image_group", "topic_cluster")
LENS_ROWS, LENS_PLACES, DIGEST_ROWS, LEAST_LIKES, DIGEST_DAYS = 30, 3, 20, 20, 30


def pool(spark: SparkSession, sf: str) -> DataFrame:
    """(id, lens, size): U3: what four lenses single out among others' recent posts: outliers, most liked, image and topic groups.

    A group counts by its member with most likes. Every lens is bounded.
    """
    rows = sim.flagged(spark, sf, ["author_id", "platform", "posted_at", "likes", "shares", "x_factor"])
    rows = rows.where((F.col("platform") == "linkedin") & (F.col("author_id") != OWN) & (F.unix_millis("posted_at") >= S.NOW_MS - DIGEST_DAYS * _D)).drop("author_id", "platform", "posted_at")
    top = lambda df, key: df.orderBy(F.desc(key), "id").limit(LENS_ROWS).select("id")
    one = F.lit(1).cast("long").alias("size")
    found = [top(rows.where(F.col("x_factor").isNotNull() & ~F.isnan("x_factor") & (F.col("likes") >= LEAST_LIKES)), "x_factor").select("id", F.lit(LENSES[0]).alias("lens"), one), top(rows, "likes").select("id", F.lit(LENSES[1]).alias("lens"), one)]
    for lens, need, kind, least in ((LENSES[2], "image", "image_star", S.IMAGE_SIMILAR), (LENSES[3], "text", "star", S.CONTENT_SIMILAR)):
        some = sim.with_vectors(spark, sf, rows.where(F.col(need).isNotNull()).orderBy(F.desc("likes"), "id").limit(S.CANDIDATES))
        found.append(v.candidate_groups(some, (sim.DIM, sim.IMAGE_DIM), kind, least).select(F.col("top_id").alias("id"), F.lit(lens).alias("lens"), "size"))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


_RECENT = f"(SELECT * FROM {POSTS} WHERE platform = 'linkedin' AND author_id <> '{OWN}' AND epoch_ms(posted_at) >= {S.NOW_MS - DIGEST_DAYS * _D})"
_POOL = f"""{sim._stars("i", f"(SELECT id, likes, shares, image_embedding::DOUBLE[] AS x FROM {_RECENT} WHERE image_embedding IS NOT NULL)", 96, 0.8)}, {sim._stars("t", f"(SELECT id, likes, shares, embedding::DOUBLE[] AS x FROM {_RECENT} WHERE embedding IS NOT NULL)", 128, 0.65)},
  l AS (SELECT id, 'xfactor' AS lens, 1 AS size FROM (SELECT id FROM {_RECENT} WHERE likes >= 20 AND x_factor IS NOT NULL AND NOT isnan(x_factor) ORDER BY x_factor DESC, id LIMIT 30) UNION ALL SELECT id, 'likes', 1 FROM (SELECT id FROM {_RECENT} ORDER BY likes DESC, id LIMIT 30)
    UNION ALL SELECT c.id, 'image_group', len(members) FROM i_g g JOIN i_c c ON c.i = g.i UNION ALL SELECT c.id, 'topic_cluster', len(members) FROM t_g g JOIN t_c c ON c.i = g.i),
  pooled AS (SELECT id, string_agg(DISTINCT lens, ',' ORDER BY lens) AS sources, count(DISTINCT lens) AS n, max(size) AS size FROM l GROUP BY id)"""


@query("U3_lenses", f"WITH RECURSIVE {_POOL} SELECT id, sources, size FROM pooled")
def lenses(spark: SparkSession, sf: str) -> DataFrame:
    return pool(spark, sf).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("lens")), ",").alias("sources"), F.max("size").alias("size"))


def digest_of(spark: SparkSession, sf: str, goal: str = "balanced") -> DataFrame:
    """(id, sources, size, status, score, place): C31, W10: the twenty best of the pool for a goal.

    Agreement of lenses and large groups raise a score, what was said before lowers it. Of the image and topic groups the three best
    that were not posted before have a place each; the rest goes by score.
    """
    found = stored(pool(spark, sf), "lenses")
    p = found.groupBy("id").agg(F.array_sort(F.collect_set("lens")).alias("lenses"), F.max("size").alias("size"))
    rows = sim.flagged(spark, sf, ["likes", "comments", "x_factor"]).join(F.broadcast(p), "id")  # a bounded pool
    rows = stored(rows, "pool")
    rows = rows.join(sim.novelty_of(spark, sf, rows).select("id", "status"), "id")
    weights = GOALS.get(goal, GOALS["balanced"])
    n = F.size("lenses")
    score = weights[0] * F.coalesce(F.when(~F.isnan("x_factor"), F.col("x_factor")), F.lit(0.0)) + weights[1] * F.log1p(F.coalesce("likes", F.lit(0))) + weights[2] * F.log1p(F.coalesce("comments", F.lit(0)))
    score = score * (1 + 0.15 * (n - 1)) * (1 + 0.05 * F.least(F.col("size") - 1, F.lit(10)))
    rows = rows.withColumn("score", F.round(F.when(F.col("status") == "posted", score * 0.05).when(F.col("status") == "recently_covered", score * 0.15).otherwise(score), 6))
    best = [F.desc("score"), F.col("id")]
    fresh = F.col("status") != "posted"
    for lens in LENSES[2:]:
        has = F.array_contains("lenses", lens) & fresh
        rows = rows.withColumn(lens, has & (F.sum(has.cast("int")).over(Window.orderBy(*best).rowsBetween(Window.unboundedPreceding, 0)) <= LENS_PLACES))
    rows = rows.withColumn("reserved", F.col(LENSES[2]) | F.col(LENSES[3]))
    rows = rows.withColumn("r", F.row_number().over(Window.orderBy(F.desc("reserved"), *best))).where(F.col("r") <= DIGEST_ROWS)
    place = F.row_number().over(Window.orderBy(*best)).cast("long").alias("place")
    return rows.select("id", F.array_join("lenses", ",").alias("sources"), "size", "status", "score", place)


def _digest_sql(goal: str) -> str:
    x, likes, comments = GOALS[goal]
    return f"""WITH RECURSIVE {_POOL}, h AS (SELECT * FROM {sim._novelty_sql(f"(SELECT id, embedding FROM {POSTS} WHERE id IN (SELECT id FROM pooled))")}),
  s AS (SELECT p.id, sources, size, status, round((CASE status WHEN 'posted' THEN 0.05 WHEN 'recently_covered' THEN 0.15 ELSE 1 END)::DOUBLE * ({x}::DOUBLE * coalesce(CASE WHEN NOT isnan(x_factor) THEN x_factor END, 0) + {likes}::DOUBLE * ln(1 + coalesce(likes, 0)) + {comments}::DOUBLE * ln(1 + coalesce(comments, 0))) * (1 + 0.15::DOUBLE * (n - 1)) * (1 + 0.05::DOUBLE * least(size - 1, 10)), 6) AS score
    FROM pooled p JOIN h USING (id) JOIN {POSTS} USING (id)),
  k AS (SELECT *, (sources LIKE '%image_group%' AND status <> 'posted' AND row_number() OVER (PARTITION BY sources LIKE '%image_group%' AND status <> 'posted' ORDER BY score DESC, id) <= 3) OR (sources LIKE '%topic_cluster%' AND status <> 'posted' AND row_number() OVER (PARTITION BY sources LIKE '%topic_cluster%' AND status <> 'posted' ORDER BY score DESC, id) <= 3) AS reserved FROM s),
  best AS (SELECT * FROM k ORDER BY reserved DESC, score DESC, id LIMIT 20) SELECT id, sources, size, status, score, row_number() OVER (ORDER BY score DESC, id) AS place FROM best"""


@query("Q22_U3_W10_digest", _digest_sql("balanced"))
def digest(spark: SparkSession, sf: str) -> DataFrame:
    return digest_of(spark, sf)


@query("C31_digest_for_growth", _digest_sql("grow"))
def digest_for_growth(spark: SparkSession, sf: str) -> DataFrame:
    return digest_of(spark, sf, "grow")


_BUCKET = "CASE WHEN likes >= 1000 THEN 'viral' WHEN likes >= 750 THEN 'great' WHEN likes >= 500 THEN 'good' WHEN likes >= 200 THEN 'ok' ELSE 'flop' END"


@query("Q23_daily_performance", f"""WITH p AS (SELECT *, {S.NOW_MS} - epoch_ms(posted_at) AS age FROM {POSTS}), g AS ({growth.CREATOR_GROWTH}) SELECT id, p.likes, p.comments, p.shares, CASE WHEN NOT isnan(x_factor) THEN x_factor END AS x_factor, floor(age / 3600000.0::DOUBLE * 10 + 0.5) / 10 AS hours_live, {_BUCKET} AS bucket, g.gained
    FROM p LEFT JOIN g ON g.attributable_post_id = p.id AND g.author_id = p.author_id WHERE age BETWEEN {20 * 3_600_000} AND {30 * 3_600_000}""")
def daily_performance(spark: SparkSession, sf: str) -> DataFrame:
    """Posts that are 20 to 30 hours old, with the bucket of their likes and the followers gained on a day that is theirs alone."""
    rows = posts(spark, sf, ["author_id", "posted_at", "likes", "comments", "shares", "x_factor"]).withColumn("age", S.NOW_MS - F.unix_millis("posted_at")).where(F.col("age").between(20 * 3_600_000, 30 * 3_600_000))
    gains = growth.creator_growth(spark, sf).where("attributable_post_id IS NOT NULL").select("author_id", F.col("attributable_post_id").alias("id"), "gained")
    rows = rows.join(gains, ["id", "author_id"], "left")
    return rows.select("id", "likes", "comments", "shares", F.when(~F.isnan("x_factor"), F.col("x_factor")).alias("x_factor"), (F.floor(F.col("age") / 3_600_000.0 * 10 + 0.5) / 10).alias("hours_live"), sc.bucket(F.col("likes")).alias("bucket"), "gained")


@query("K8_new_log_rows", f"SELECT id FROM {POSTS} WHERE {S.NOW_MS} - epoch_ms(posted_at) BETWEEN {20 * 3_600_000} AND {30 * 3_600_000} AND id NOT IN (SELECT post_id FROM post_snapshots WHERE captured_on = DATE '2026-06-29')")
def new_log_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows to append to the log: those that it does not have for the day."""
    logged = table(spark, sf, "post_snapshots").where("captured_on = DATE '2026-06-29'").select(F.col("post_id").alias("id"))
    return daily_performance(spark, sf).select("id").join(logged, "id", "left_anti")


@query("Q27_manifest")
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Every registered query with the operators its name covers."""
    from murmur.plans import registry

    names = sorted(registry.queries())
    rows = spark.createDataFrame([(n,) for n in names], "query string")
    return rows.withColumn("operators", F.array_join(F.filter(F.split("query", "_"), lambda x: x.rlike(r"^[A-Z]+\d+$")), ","))


@query("S17_J16_drafts", f"""WITH d AS (SELECT id, (posted_at AT TIME ZONE 'UTC')::DATE AS day, platform, embedding::DOUBLE[] AS x, epoch_ms(posted_at) AS ms FROM {POSTS} WHERE author_id = '{OWN}' AND posted_at IS NOT NULL AND {sim._USABLE}),
    m AS (SELECT p.id, min({{'s': -round(list_cosine_similarity(p.x, d.x), 6), 'draft': d.id, 'archetype': d.platform}}) AS b FROM d p JOIN d ON d.id <> p.id AND d.day BETWEEN p.day - {S.DRAFT_DAYS} AND p.day WHERE p.ms >= {S.NOW_MS - 90 * _D} GROUP BY p.id)
    SELECT id, b['draft'] AS draft, b['archetype'] AS archetype, -b['s'] AS similarity FROM m WHERE -b['s'] >= {S.DRAFT_SIMILAR}""")
def drafts(spark: SparkSession, sf: str) -> DataFrame:
    """Own posts of 90 days and the draft each grew out of. The tables hold no drafts, so the author's other texts stand for them.

    Dated draft files are read by ``sources.landing.draft_files``.
    """
    first = S.NOW_MS - 90 * _D
    day = F.to_date("posted_at")
    needed = (F.col("author_id") == OWN) & (day >= F.date_sub(F.to_date(F.timestamp_millis(F.lit(first))), S.DRAFT_DAYS))
    # of other rows only id and version are shuffled
    rows = table(spark, sf, "posts").withColumn("own", F.when(needed, F.struct(day.alias("day"), "platform", F.col("embedding").alias("x"), F.unix_millis("posted_at").alias("ms"))))
    own = stored(latest(rows, ["own"]).where("own IS NOT NULL").select("id", "own.*"), "own")
    return v.draft_matches(own.where(F.col("ms") >= first), own.select(F.col("id").alias("draft"), "day", F.col("platform").alias("archetype"), F.col("x").alias("y")), sim.DIM)


_INPUT = f"(SELECT DISTINCT trim(x) AS x FROM (SELECT profile_url AS x FROM creators UNION ALL SELECT '@' || author_id FROM creators) WHERE trim(x) <> '')"


@query("C19_creator_input", f"""WITH i AS {_INPUT}, p AS (SELECT x, CASE WHEN x ILIKE '%links.example%' THEN 'linkedin' WHEN x ILIKE '%letters.example%' THEN 'substack' WHEN x ILIKE '%pics.example%' THEN 'instagram' ELSE 'twitter' END AS platform, lower(regexp_extract(x, '^https?://([^/?#]+)', 1)) AS h, regexp_extract(x, '^https?://[^/?#]+(/[^?#]*)', 1) AS path FROM i),
  s AS (SELECT x, platform, CASE platform WHEN 'linkedin' THEN nullif(regexp_extract(x, '(?i)/(?:in|company)/([^/?#]+)', 1), '') WHEN 'substack' THEN CASE WHEN h IN ('letters.example', 'www.letters.example') THEN nullif(regexp_extract(path, '^/@([A-Za-z0-9_-]+)', 1), '') ELSE CASE WHEN regexp_extract(h, '^([a-z0-9-]+)\\.letters\\.example$', 1) NOT IN ('', 'www', 'open') THEN regexp_extract(h, '^([a-z0-9-]+)\\.letters\\.example$', 1) END END
    WHEN 'instagram' THEN CASE WHEN lower(regexp_extract(path, '^/@?([A-Za-z0-9._]+)', 1)) NOT IN ('', 'p', 'reel', 'reels', 'tv', 'explore', 'stories', 's', 'accounts') THEN lower(regexp_extract(path, '^/@?([A-Za-z0-9._]+)', 1)) END
    ELSE nullif(CASE WHEN regexp_matches(x, '^https?://', 'i') THEN regexp_extract(x, '(?i)chirp\\.example/@?([A-Za-z0-9_]+)', 1) ELSE regexp_extract(x, '^@?([A-Za-z0-9_]+)$', 1) END, '') END AS slug FROM p)
  SELECT x, CASE WHEN slug IS NOT NULL OR platform = 'linkedin' THEN platform END AS platform, slug FROM s""")
def creator_input(spark: SparkSession, sf: str) -> DataFrame:
    """Lines a user types, one or more accounts each, to platform and slug: the urls and ids of all accounts."""
    typed = table(spark, sf, "creators").select(F.concat_ws(" ,\n", "profile_url", F.concat(F.lit("@"), "author_id")).alias("t"))
    x = F.col("x")
    rows = typed.select(F.explode(F.split("t", r"[\n,]")).alias("x")).select(F.trim("x").alias("x")).where("x <> ''").distinct()
    return rows.select("x", *[c.alias(n) for n, c in sc.creator_input(x, S.TEST_SITES).items() if n != "profile_url"])


@query("J20_group_members", f"WITH g AS (SELECT author_id, string_agg(id, '|' ORDER BY id) AS ids FROM {POSTS} WHERE author_id <> '' GROUP BY author_id HAVING count(*) >= 2), e AS (SELECT author_id, unnest(string_split(ids, '|')) AS id FROM g) SELECT e.author_id, e.id, p.likes FROM e JOIN {POSTS} p USING (id)")
def group_members(spark: SparkSession, sf: str) -> DataFrame:
    """Groups given as lists of ids, expanded to their posts: here all authors with two posts or more, in lists of at most 1,000 ids."""
    rows = posts(spark, sf, ["author_id", "likes"])
    held = rows.where("author_id <> ''")
    several = held.groupBy("author_id").agg(F.count("*").alias("n")).where("n >= 2")
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / 500)).alias("part")
    lists = held.join(several, "author_id").groupBy("author_id", part).agg(F.collect_list("id").alias("ids"))
    return lists.select("author_id", F.explode("ids").alias("id")).join(rows.select("id", "likes"), "id").select("author_id", "id", "likes")
