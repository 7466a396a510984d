"""Queries of the training-data operators over the social-post tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm import cap, clusters, encode, features, knn, langid, mixing, neardup, quantiles, topn
from murmur.operators.versions import latest
from murmur.sources.shared import stored
from murmur.sources.tables import spread, table

VECTOR_FIELDS = {"embedding": 128, "image_embedding": 96}


def _named(column: str) -> F.Column:
    return F.col(column).isNotNull() & (F.col(column) != "")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    lists = knn.similar(table(spark, sf, "posts"), VECTOR_FIELDS, k=10, least=0.8)
    return lists.select("field", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.record_pairs(*neardup.pairs(spread(table(spark, sf, "posts")), "content", run=3, overlap=0.6, least_words=30))


def _classes(links: DataFrame, members: DataFrame) -> DataFrame:
    """(post_id, class_id, links): one row a post with its class and the number of classes linked to that."""
    ends = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    return members.join(ends, "cls", "left").select(F.col("id").alias("post_id"), F.lower(F.hex("cls")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    """What p2_found says, without one row for every pair of copies."""
    return _classes(*neardup.pairs(spread(table(spark, sf, "posts")), "content", run=3, overlap=0.6, least_words=30))


def p2_five_words(spark: SparkSession, sf: str) -> DataFrame:
    """Every post of five words or more, by the default of five words and 0.8."""
    return _classes(*neardup.pairs(spread(table(spark, sf, "posts")), "content"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    posts = latest(table(spark, sf, "posts"), ["author_id", "x_score"]).where(_named("author_id"))
    return topn.top_n(posts, "author_id", "x_score", "id", 5).select("author_id", F.col("id").alias("post_id"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.clusters(table(spark, sf, "posts"), "embedding", 128, text="content").select(F.col("id").alias("post_id"), "cluster_id")


def p4_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.describe(clusters.clusters(table(spark, sf, "posts"), "embedding", 128, text="content"))


def p4_text_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Posts alike in their words: clusters over hashed weighted features of the content."""
    rows = stored(features.text_vectors(spread(table(spark, sf, "posts")), "id", "content", "scraped_at"), "features")
    return clusters.describe(clusters.clusters(rows, "x", 128))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    posts = latest(table(spark, sf, "posts"), ["author_id", "weighted_score", "creator_baseline"]).where(_named("author_id"))
    return quantiles.score_shapes(posts, "author_id", "weighted_score", "creator_baseline")


def p6_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    posts = latest(table(spark, sf, "posts"), ["author_id", "weighted_score", "creator_baseline"]).where(_named("author_id"))
    columns = ["weighted_score", "creator_baseline"]
    ps = [0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
    found = quantiles.percentiles(quantiles.sketches(posts, "author_id", columns), "author_id", ps)
    shown = [F.round(F.get("value", F.lit(i)), 6).alias(f"p{int(p * 100)}") for i, p in enumerate(ps)]
    return found.select("author_id", "metric", "n", *shown, F.round(F.get("lo", F.lit(2)), 6).alias("median_lo"), F.round(F.get("hi", F.lit(2)), 6).alias("median_hi"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    posts = latest(table(spark, sf, "posts"), ["author_id", "x_factor"]).where(_named("author_id"))
    kept = cap.cap_contributors(posts, "author_id", "x_factor", "id", cap=20)
    return kept.where("total > 20").select("author_id", F.col("id").alias("post_id"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.corpus_ids(spread(table(spark, sf, "documents")), "doc_id", "text")


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents are encoded once; plan, mixture and report read the sizes."""
    return stored(encode.token_counts(spread(table(spark, sf, "documents")), ["doc_id", "source"], "text"), "sizes")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_shares(spark, sf).where("capped").select("source")


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture(_sizes(spark, sf), "doc_id", "source", "tokens", table(spark, sf, "mix_targets"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.report(_sizes(spark, sf), "doc_id", "source", "tokens", table(spark, sf, "mix_targets"))


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    documents = spread(table(spark, sf, "documents"))
    trained = langid.train(documents, "doc_id", "text", "lang", table(spark, sf, "lang_samples"))
    return langid.classify(documents, "doc_id", "text", "lang", trained)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return langid.wrong_labels(_segments(spark, sf), "doc_id")


def p10_segments(spark: SparkSession, sf: str) -> DataFrame:
    return _segments(spark, sf).select("doc_id", "segment", "lang", "sentences", "chars", "confidence")


def p10_languages(spark: SparkSession, sf: str) -> DataFrame:
    return langid.held_languages(_segments(spark, sf), "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p2_found, p2_classes, p2_five_words, p3_found, p4_found, p4_clusters, p4_text_clusters, p6_found, p6_percentiles, p7_found, p8_ids, p9_found, p9_mixture, p9_shares, p10_found, p10_segments, p10_languages)
    return {f.__name__: f for f in found}


LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY scraped_at DESC) AS version FROM posts) WHERE version = 1)"


def oracle_sql() -> dict[str, str]:
    named = "author_id IS NOT NULL AND author_id <> ''"
    at = ", ".join(f"round(quantile_cont(v, {p}), 6) AS p{int(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9, 0.99))
    return {
        # exact while no author has more than quantiles.K values, as up to scale 0.01; beyond that the query's bounds hold the exact value
        "p6_percentiles": f"""SELECT author_id, metric, count(*) AS n, {at}, round(quantile_cont(v, 0.5), 6) AS median_lo, round(quantile_cont(v, 0.5), 6) AS median_hi FROM (SELECT author_id, 'weighted_score' AS metric, weighted_score AS v FROM {LATEST} WHERE {named}
            UNION ALL SELECT author_id, 'creator_baseline', creator_baseline FROM {LATEST} WHERE {named}) WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY author_id, metric""",
        "p3_found": f"""SELECT author_id, id AS post_id FROM (SELECT author_id, id, row_number() OVER (PARTITION BY author_id ORDER BY x_score DESC, id) AS r
            FROM {LATEST} WHERE {named} AND x_score IS NOT NULL) WHERE r <= 5""",
        "p6_found": f"""WITH a AS (SELECT author_id, count(weighted_score) AS n, quantile_cont(weighted_score, 0.5) AS m, quantile_cont(weighted_score, 0.9) AS t,
            quantile_cont(creator_baseline, 0.5) AS b FROM {LATEST} WHERE {named} GROUP BY author_id HAVING count(weighted_score) >= 15)
            SELECT author_id, 'tail' AS kind FROM a WHERE t >= 10 * m UNION ALL SELECT author_id, 'drift' AS kind FROM a WHERE m >= 3 * b OR m <= b / 3""",
        "p7_found": f"""SELECT author_id, id AS post_id FROM (SELECT author_id, id, count(*) OVER (PARTITION BY author_id) AS n, row_number() OVER (PARTITION BY author_id
            ORDER BY CASE WHEN x_factor IS NULL OR isnan(x_factor) THEN 1 ELSE 0 END, CASE WHEN isnan(x_factor) THEN NULL ELSE x_factor END DESC, id) AS r
            FROM {LATEST} WHERE {named}) WHERE r <= 20 AND n > 20""",
    }
