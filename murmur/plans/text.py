"""Full-text and hybrid search over posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.operators import similarity as v
from murmur.operators import text as t
from murmur.operators.versions import latest, version_of
from murmur.plans.corpus import POSTS, posts
from murmur.plans.registry import query
from murmur.plans.similarity import _COSINE, _QUERY, _USABLE, live_scores, query_vector
from murmur.sources import settings as S
from murmur.sources.shared import stored
from murmur.sources.tables import table

TERMS = ("pricing", "renewal survey", "heat pump")
_TOKENS = f"(SELECT id, posted_at, list_filter(string_split_regex(lower(coalesce(content, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM {POSTS})"
_P = f"(SELECT id, unnest(t) AS token, generate_subscripts(t, 1) AS pos, len(t) AS n FROM {_TOKENS})"
_HOLD = f"""(SELECT id, count(DISTINCT p) AS phrases FROM (SELECT id, 0 AS p FROM {_P} WHERE token = 'pricing' UNION ALL SELECT a.id, 1 FROM {_P} a JOIN {_P} b ON a.id = b.id AND b.pos = a.pos + 1 AND a.token = 'renewal' AND b.token = 'survey'
    UNION ALL SELECT a.id, 2 FROM {_P} a JOIN {_P} b ON a.id = b.id AND b.pos = a.pos + 1 AND a.token = 'heat' AND b.token = 'pump') GROUP BY id)"""


@query("T1_T2_postings", f"SELECT token, id, count(*) AS tf, string_agg((pos - 1)::VARCHAR, ',' ORDER BY pos) AS places FROM {_P} GROUP BY token, id")
def postings(spark: SparkSession, sf: str) -> DataFrame:
    p = t.postings(posts(spark, sf, ["content"]), "id", "content", stems=False)
    return p.select("token", "id", "tf", F.array_join(F.transform("places", lambda x: x.cast("string")), ",").alias("places"))


@query("T1_stemmed_vocabulary")
def stems(spark: SparkSession, sf: str) -> DataFrame:
    """Every stem with the posts that hold it."""
    return t.postings(posts(spark, sf, ["content"]), "id", "content").groupBy("token").agg(F.count("*").alias("posts"))


@query("X6_T8_maintained_index", f"SELECT (SELECT count(*) FROM (SELECT DISTINCT token, id FROM {_P})) AS postings, 0 AS missing, 0 AS stray, (SELECT count(*) FROM (SELECT id FROM posts GROUP BY id HAVING count(DISTINCT coalesce(content, '')) + count(DISTINCT content IS NULL) > 2)) AS changed")
def maintained_index(spark: SparkSession, sf: str) -> DataFrame:
    """The index of every post's first version, brought up to its latest, checked against the texts."""
    first = table(spark, sf, "posts").groupBy("id").agg(F.min_by(F.struct("content"), version_of()).alias("c")).select("id", "c.content")
    last = posts(spark, sf, ["content"])
    index = t.maintained(t.postings(first, "id", "content", stems=False), first, last, "id", "content", stems=False)
    texts = table(spark, sf, "posts").groupBy("id").agg((F.countDistinct(F.coalesce("content", F.lit(""))) + F.countDistinct(F.col("content").isNull())).alias("n"))
    return t.integrity(index, last, "id", "content", stems=False).crossJoin(texts.agg(F.count_if(F.col("n") > 2).alias("changed")))


@query("F2_T4_match_any", f"SELECT id, phrases FROM {_HOLD}")
def match_any(spark: SparkSession, sf: str) -> DataFrame:
    return t.matches(posts(spark, sf, ["content"]), "id", "content", TERMS, "any", stems=False)


@query("F2_T5_match_all", "SELECT id FROM (SELECT id, count(DISTINCT token) AS n FROM " + _P + " WHERE token IN ('pricing', 'team') GROUP BY id) WHERE n = 2")
def match_all(spark: SparkSession, sf: str) -> DataFrame:
    return t.matches(posts(spark, sf, ["content"]), "id", "content", ("pricing", "team", "PRICING"), "all", stems=False).select("id")


@query("F2_nothing_searchable", "SELECT '' AS id WHERE false")
def nothing(spark: SparkSession, sf: str) -> DataFrame:
    return t.matches(posts(spark, sf, ["content"]), "id", "content", ("!!!", " - ")).select("id")


_BM25 = f"""(WITH s AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM {_TOKENS}), f AS (SELECT id, token, count(*) AS tf, any_value(n) AS n FROM {_P} WHERE token IN ('pricing', 'renewal', 'survey', 'heat', 'pump') GROUP BY id, token),
  d AS (SELECT token, count(*) AS df FROM f GROUP BY token) SELECT id, -sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS bm25 FROM f JOIN d USING (token), s GROUP BY id)"""


@query("T6_O6_bm25", f"SELECT id, round(bm25, 6) AS bm25 FROM {_BM25} JOIN {POSTS} USING (id) ORDER BY round(bm25, 6), posted_at DESC NULLS LAST, id LIMIT 500")
def bm25(spark: SparkSession, sf: str) -> DataFrame:
    rows = posts(spark, sf, ["content", "posted_at"])
    r = t.ranked(rows, "id", "content", TERMS, stems=False).withColumn("bm25", F.round("bm25", 6))
    return r.join(rows.select("id", "posted_at"), "id").orderBy("bm25", F.desc_nulls_last("posted_at"), "id").limit(S.RETRIEVED).select("id", "bm25")


@query("T6_stemmed_search")
def stemmed_search(spark: SparkSession, sf: str) -> DataFrame:
    terms = ("renewals", "shipping")
    rows = stored(latest(t.condensed(table(spark, sf, "posts"), "content", terms), ["content"]), "condensed")
    held = t.matches(rows, "id", "content", terms)
    return t.ranked(rows, "id", "content", terms).join(held, "id").orderBy("bm25", "id").limit(S.RETRIEVED)


@query("V8_Q2_hybrid", f"""WITH a AS (SELECT id, row_number() OVER (ORDER BY round(bm25, 6), posted_at DESC NULLS LAST, id) AS r FROM {_BM25} JOIN {POSTS} USING (id) QUALIFY r <= 500),
  b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT a.id, {_COSINE} AS score FROM (SELECT * FROM {POSTS} WHERE {_USABLE}) a, {_QUERY} q) QUALIFY r <= 500),
  f AS (SELECT id, sum(1.0::DOUBLE / (60 + r)) AS score, min({{'l': l, 'r': r}}) AS first FROM (SELECT *, 0 AS l FROM a UNION ALL SELECT *, 1 AS l FROM b) GROUP BY id)
  SELECT id, round(score, 9) AS score, row_number() OVER (ORDER BY score DESC, first, id) AS place, (SELECT count(*) FROM f) AS total FROM f QUALIFY place <= 50""")
def hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 and vectors, 500 each, fused by reciprocal rank; one page."""
    words = bm25(spark, sf).join(posts(spark, sf, ["posted_at"]), "id")
    near = v.best_scored(live_scores(spark, sf, query_vector(spark, sf)), "id")
    by = lambda *o: F.row_number().over(Window.orderBy(*o))  # noqa: E731 - 500 rows each
    lists = [words.select("id", by("bm25", F.desc_nulls_last("posted_at"), "id").alias("rank")), near.select("id", by(F.desc("score"), "id").alias("rank"))]
    f = v.fused(lists, "id")
    n = f.agg(F.count("*").alias("total"))  # one row
    return f.where("place <= 50").crossJoin(F.broadcast(n)).select("id", F.round("score", 9).alias("score"), "place", "total")
