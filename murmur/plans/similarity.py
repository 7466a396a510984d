"""Vector queries over posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.operators import similarity as v
from murmur.operators.versions import latest, version_of
from murmur.plans.corpus import POSTS, posts
from murmur.plans.registry import query
from murmur.sources import settings as S
from murmur.sources.tables import table

DIM, IMAGE_DIM = 128, 96
_USABLE = "embedding IS NOT NULL AND len(embedding) = 128 AND list_aggregate(embedding, 'sum') IS NOT NULL AND NOT isnan(list_sum(embedding)) AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0"
_COSINE = "round(list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"
_QUERY = f"(SELECT embedding FROM {POSTS} WHERE {_USABLE} ORDER BY id LIMIT 1)"


def usable(field: str, dim: int) -> F.Column:
    """Right length, no null or NaN, not all zero; in the JVM."""
    x = F.col(field)
    return x.isNotNull() & (F.size(x) == dim) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e)) & F.exists(x, lambda e: e != 0)


def query_vector(spark: SparkSession, sf: str) -> list[float]:
    """The vector that stands for an embedded question: that of the smallest id (one row)."""
    rows = table(spark, sf, "posts").where("id IS NOT NULL").select("id", version_of().alias("v"), "embedding").orderBy("id", F.desc("v"))
    n = 64
    while True:
        first = rows.limit(n).collect()
        seen = set()
        for r in first:
            if r["id"] not in seen and good_vector(r["embedding"]):
                return list(r["embedding"])
            seen.add(r["id"])
        if len(first) < n:
            return []
        n *= 16


def good_vector(x: list | None, dim: int = DIM) -> bool:
    """``usable`` of one value."""
    return x is not None and len(x) == dim and all(e is not None and e == e for e in x) and any(x)


def live_vectors(spark: SparkSession, sf: str, field: str, more: tuple[str, ...] = ()) -> DataFrame:
    """(id, x, ...): the vectors of the latest versions."""
    return latest(table(spark, sf, "posts").withColumn("x", F.col(field)), ["x", *more])


def live_scores(spark: SparkSession, sf: str, vector: list[float], more: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, more...): scores of the latest versions; vectors are scored in the scan, only numbers are shuffled."""
    rows = v.scored(table(spark, sf, "posts"), "id", "embedding", vector, ["scraped_at", *more])
    return latest(rows, ["score", *more])


@query("V5_O5_nearest", f"SELECT a.id, {_COSINE} AS score FROM (SELECT * FROM {POSTS} WHERE {_USABLE}) a, {_QUERY} q ORDER BY score DESC, a.id LIMIT 500")
def nearest(spark: SparkSession, sf: str) -> DataFrame:
    return v.best_scored(live_scores(spark, sf, query_vector(spark, sf)), "id")


@query("V5_filtered_nearest", f"SELECT a.id, {_COSINE} AS score FROM (SELECT * FROM {POSTS} WHERE {_USABLE} AND platform = 'substack' AND likes >= 20) a, {_QUERY} q ORDER BY score DESC, a.id LIMIT 50")
def filtered_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """Filters hold before ranking."""
    rows = live_scores(spark, sf, query_vector(spark, sf), ("platform", "likes")).where("platform = 'substack' AND likes >= 20")
    return v.best_scored(rows, "id", 50)


@query("V6_index_report", f"SELECT count(embedding) AS vectors, count(*) FILTER (len(embedding) = 128) AS right_length, count(*) FILTER (len(embedding) <> 128) AS skipped FROM {POSTS}")
def index_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = latest(table(spark, sf, "posts").withColumn("n", F.when(F.col("embedding").isNotNull(), F.size("embedding"))), ["n"])
    return rows.agg(F.count("n").alias("vectors"), F.count_if(F.col("n") == DIM).alias("right_length"), F.count_if(F.col("n") != DIM).alias("skipped"))


TEXTS = ["content", "image_description"]


def candidates(spark: SparkSession, sf: str, need: str) -> DataFrame:
    """The CANDIDATES posts with most likes that have the vectors needed; the bound is the feature.

    Only which vectors a post has goes through the version rule; the vectors are fetched for the candidates.
    """
    return with_vectors(spark, sf, flagged(spark, sf, ["likes", "shares", *TEXTS]).where(need).orderBy(F.desc("likes"), "id").limit(S.CANDIDATES))


def flagged(spark: SparkSession, sf: str, columns: list[str]) -> DataFrame:
    """(id, columns, text, image, v): the latest version of each post, ``text`` and ``image`` set where it has that vector."""
    has = {"text": F.when(F.col("embedding").isNotNull(), True), "image": F.when(F.col("image_embedding").isNotNull(), True)}
    rows = table(spark, sf, "posts").select("id", "scraped_at", version_of().alias("v"), *[c for c in columns if c not in ("id", "scraped_at")], *[h.alias(n) for n, h in has.items()])
    return latest(rows, ["v", *columns, "text", "image"])


def with_vectors(spark: SparkSession, sf: str, few: DataFrame) -> DataFrame:
    """A bounded number of rows (id, v, ...) of ``flagged`` with their vectors as ``text`` and ``image``."""
    few = few.drop("text", "image")
    stored_ = table(spark, sf, "posts").select("id", version_of().alias("v"), F.col("embedding").alias("text"), F.col("image_embedding").alias("image"))
    return stored_.join(F.broadcast(few), ["id", "v"]).dropDuplicates(["id"]).drop("v")


def _stars(name: str, rows: str, dim: int, least: float) -> str:
    """CTEs <name>_c (i, id, likes, shares, x) and <name>_g (i, members): star groups among candidates in order of likes, then id."""
    return f"""{name}_c AS (SELECT * FROM (SELECT id, likes, shares, x, row_number() OVER (ORDER BY likes DESC, id) AS i FROM {rows} ORDER BY i LIMIT 400) WHERE len(x) = {dim} AND NOT isnan(list_sum(x)) AND list_sum(list_transform(x, lambda y: abs(y))) > 0),
  {name}_e AS (SELECT a.i, list(b.i ORDER BY b.i) AS nb FROM {name}_c a JOIN {name}_c b ON a.i < b.i AND round(list_cosine_similarity(a.x, b.x), 6) >= {least} GROUP BY a.i),
  {name}_r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS used, []::BIGINT[] AS fresh UNION ALL SELECT i, list_concat(used, CASE WHEN len(fresh) > 0 THEN [i] ELSE []::BIGINT[] END, fresh), fresh FROM
    (SELECT r.i + 1 AS i, r.used, CASE WHEN list_contains(r.used, r.i + 1) THEN []::BIGINT[] ELSE list_filter(coalesce(e.nb, []::BIGINT[]), lambda v: NOT list_contains(r.used, v)) END AS fresh FROM {name}_r r LEFT JOIN {name}_e e ON e.i = r.i + 1 WHERE r.i < 400)),
  {name}_g AS (SELECT i, list_concat([i], fresh) AS members FROM {name}_r WHERE len(fresh) > 0)"""


_IMAGES = f"""WITH RECURSIVE c AS (SELECT id, likes, shares, content, image_description, image_embedding::DOUBLE[] AS x, len(image_embedding) = 96 AND NOT isnan(list_sum(image_embedding)) AND list_sum(list_transform(image_embedding, lambda y: abs(y))) > 0 AS ok FROM {POSTS} WHERE embedding IS NOT NULL AND image_embedding IS NOT NULL ORDER BY likes DESC, id LIMIT 400),
  u AS (SELECT * FROM c WHERE ok), e AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.x, b.x), 6) AS s FROM u a JOIN u b ON a.id <> b.id), l AS (SELECT a, b FROM e WHERE s >= 0.8),
  r AS (SELECT DISTINCT a AS id, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id), g AS (SELECT id, min(root) AS root FROM r GROUP BY id),
  m AS (SELECT g1.root, avg(s) AS similarity FROM e JOIN g g1 ON g1.id = e.a JOIN g g2 ON g2.id = e.b AND g1.root = g2.root GROUP BY g1.root)
  SELECT count(*) AS size, string_agg(g.id, '|' ORDER BY g.id) AS ids, round(round(any_value(similarity), 6), 4) AS similarity, sum(likes)::BIGINT AS total_likes, sum(shares)::BIGINT AS total_shares,
    min({{'n': -(likes + shares), 'l': -likes, 'id': g.id, 'label': coalesce(image_description, CASE WHEN content <> '' THEN substr(trim(content, ' '), 1, 100) END)}})['label'] AS label FROM g JOIN u USING (id) JOIN m USING (root) GROUP BY g.root"""


@query("V9_Q3_image_groups", _IMAGES)
def image_groups(spark: SparkSession, sf: str) -> DataFrame:
    top = candidates(spark, sf, "text IS NOT NULL AND image IS NOT NULL")
    g = v.labelled(v.candidate_groups(top, (DIM, IMAGE_DIM), "image", S.IMAGE_SIMILAR), top, "image")
    return g.select("size", "ids", F.round("similarity", 4).alias("similarity"), "total_likes", "total_shares", "label")


@query("V10_Q4_content_clusters")
def content_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy clusters; tested against a plain version, for SQL has no form of a greedy order over pairs that ends soon enough."""
    top = candidates(spark, sf, "text IS NOT NULL")
    return v.labelled(v.candidate_groups(top, (DIM, IMAGE_DIM), "content", S.CONTENT_SIMILAR), top, "content").drop("top_id")


@query("V11_star_groups", f"""WITH RECURSIVE {_stars("t", f"(SELECT id, likes, shares, embedding::DOUBLE[] AS x FROM {POSTS} WHERE embedding IS NOT NULL)", 128, 0.65)},
  m AS (SELECT g.i, c.* EXCLUDE (i), c.i AS j FROM (SELECT i, unnest(members) AS j FROM t_g) g JOIN t_c c ON c.i = g.j),
  s AS (SELECT a.i, avg(round(list_cosine_similarity(a.x, b.x), 6)) AS similarity FROM m a JOIN m b ON a.i = b.i AND a.j < b.j GROUP BY a.i)
  SELECT count(*) AS size, string_agg(id, '|' ORDER BY id) AS ids, round(round(any_value(similarity), 6), 4) AS similarity, sum(likes)::BIGINT AS total_likes, sum(shares)::BIGINT AS total_shares, min_by(id, j) AS top_id FROM m JOIN s USING (i) GROUP BY m.i""")
def star_groups(spark: SparkSession, sf: str) -> DataFrame:
    g = v.candidate_groups(candidates(spark, sf, "text IS NOT NULL"), (DIM, IMAGE_DIM), "star", S.CONTENT_SIMILAR)
    return g.select("size", "ids", F.round("similarity", 4).alias("similarity"), "total_likes", "total_shares", "top_id")


@query("V7_W8_fusion", f"""WITH a AS (SELECT id, row_number() OVER (ORDER BY likes DESC, id) AS r FROM {POSTS} ORDER BY r LIMIT 100), b AS (SELECT id, row_number() OVER (ORDER BY x_score DESC NULLS LAST, id) AS r FROM {POSTS} ORDER BY r LIMIT 100),
  f AS (SELECT id, sum(1.0::DOUBLE / (60 + r)) AS score, min({{'l': l, 'r': r}}) AS first FROM (SELECT *, 0 AS l FROM a UNION ALL SELECT *, 1 AS l FROM b) GROUP BY id) SELECT id, round(score, 9) AS score, row_number() OVER (ORDER BY score DESC, first, id) AS place FROM f""")
def fusion(spark: SparkSession, sf: str) -> DataFrame:
    rows = posts(spark, sf, ["likes", "x_score"])
    lists = []
    for key in (F.desc("likes"), F.desc_nulls_last("x_score")):
        top = rows.orderBy(key, "id").limit(100)
        lists.append(top.withColumn("rank", F.row_number().over(Window.orderBy(key, "id"))).select("id", "rank"))
    return v.fused(lists, "id").select("id", F.round("score", 9).alias("score"), "place")


OWN = "mira-solvane"
_STATUS = f"""CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 0.85 THEN 'posted' WHEN score >= 0.65 THEN CASE WHEN age >= 30 THEN 'refresh_candidate' ELSE 'recently_covered' END ELSE 'new' END"""


def _novelty_sql(asked: str) -> str:
    """(id, score, status, match, age_days) of the posts (id, embedding) of ``asked``."""
    return f"""(WITH d AS (SELECT id, posted_at, embedding FROM {POSTS} WHERE {_USABLE} AND author_id = '{OWN}'), n AS {asked}, u AS (SELECT id, embedding FROM n WHERE {_USABLE}),
    s AS (SELECT u.id, min({{'s': -round(list_cosine_similarity(u.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6), 'm': d.id, 'at': epoch_ms(d.posted_at)}}) AS b FROM u, d GROUP BY u.id),
    a AS (SELECT n.id, CASE WHEN u.id IS NOT NULL THEN greatest(coalesce(-b['s'], 0), 0) END AS score, b['m'] AS match, ({S.NOW_MS} - coalesce(b['at'], 0)) / {S.DAY_MS}.0::DOUBLE AS age FROM n LEFT JOIN u ON u.id = n.id LEFT JOIN s ON s.id = n.id)
    SELECT id, coalesce(score, 0) AS score, {_STATUS} AS status, CASE WHEN score >= 0.65 THEN match END AS match, CASE WHEN score >= 0.65 AND score < 0.85 THEN floor(age + 0.5)::BIGINT END AS age_days FROM a)"""


def novelty_of(spark: SparkSession, sf: str, asked: DataFrame) -> DataFrame:
    """``operators.similarity.novelty`` of a bounded number of posts (id, v) against the own posts."""
    wanted = with_vectors(spark, sf, asked.select("id", "v")).select("id", "text").collect()
    known = {r["id"]: r["text"] for r in wanted if good_vector(r["text"])}
    own = live_vectors(spark, sf, "embedding", ("author_id", "posted_at")).where(F.col("author_id") == OWN)
    matches = v.best_matches(own, "id", "x", known)
    has = spark.createDataFrame([(r["id"], r["id"] in known) for r in wanted], "id string, has boolean")
    return v.novelty(matches, has, posts(spark, sf, ["author_id", "posted_at"]).where(F.col("author_id") == OWN).select(F.col("id").alias("match"), F.unix_millis("posted_at").alias("posted_ms")), S.NOW_MS)


@query("J15_V13_novelty", f"SELECT * FROM {_novelty_sql(f'(SELECT id, embedding FROM {POSTS} WHERE author_id <> {chr(39)}{OWN}{chr(39)} AND x_score IS NOT NULL ORDER BY x_score DESC, id LIMIT 60)')}")
def novelty(spark: SparkSession, sf: str) -> DataFrame:
    """The best match of each of 60 candidates (the feature's bound) among one author's own posts, and what follows from it and its age."""
    rows = flagged(spark, sf, ["author_id", "x_score"])
    return novelty_of(spark, sf, rows.where((F.col("author_id") != OWN) & F.col("x_score").isNotNull()).orderBy(F.desc("x_score"), "id").limit(60))
