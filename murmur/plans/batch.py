"""The ingest batch from raw records to new rows and the authors to score again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators import ingest as i
from murmur.operators import mappers as m
from murmur.sources.shared import stored

MAPPERS = {"linkedin": m.network_posts, "twitter": m.micro_blog_posts, "substack": m.newsletter_posts, "instagram": m.photo_posts}


@dataclass(frozen=True)
class Ingested:
    """New rows, authors they touch, one row of counts, and the records that could not be mapped."""

    fresh: DataFrame
    authors: DataFrame
    stats: DataFrame
    errors: DataFrame


def ingest(target: DataFrame, keyword: dict[str, DataFrame], creator: dict[str, DataFrame]) -> Ingested:
    """Q24: raw records (column raw) by platform and run are mapped, gated by language, merged, and new ones kept.

    ``target``: stored posts (id, url). Of records with one id the first of the keyword run wins, ties by the record's text.
    """

    def mapped(by: dict[str, DataFrame]) -> DataFrame:
        out = None
        for platform, df in by.items():
            rows = MAPPERS[platform](df)
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            out = m.network_posts(target.sparkSession.createDataFrame([], "raw string"))
        return out

    k, c = stored(mapped(keyword), "mapped"), stored(mapped(creator), "mapped")
    errors = k.unionByName(c).where("error IS NOT NULL").select("error", "raw")
    good_k, good_c = m.accepted(k), m.accepted(c)
    merged = i.merged_sources(good_k, good_c, "id", "raw").withColumnRenamed("source", "scrape_source")
    fresh = stored(i.insert_ignore(target, merged, "id", "url", "id"), "fresh")
    count = lambda df, name: df.agg(F.count("*").alias(name))  # noqa: E731 - one row each
    stats = count(k, "raw_keyword").crossJoin(count(c, "raw_creator")).crossJoin(count(good_k.unionByName(good_c), "accepted")).crossJoin(merged.agg(F.count("*").alias("merged"), F.count_if(F.col("scrape_source") == "both").alias("found_in_both"))).crossJoin(count(fresh, "inserted"))
    stats = stats.withColumn("duplicates", F.col("accepted") - F.col("merged"))
    return Ingested(fresh, fresh.select("author_id").where("author_id <> ''").distinct(), stats, errors)
