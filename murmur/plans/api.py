"""One entry for post queries by their parameters, as an application would call it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.operators import filters as fl
from murmur.operators import similarity as v
from murmur.operators import text as t
from murmur.plans.corpus import posts
from murmur.plans.search import authors_of, matching
from murmur.plans.similarity import DIM, IMAGE_DIM, TEXTS, flagged, live_scores, with_vectors
from murmur.sources import settings as S

Embedder = Callable[[str], Sequence[float]]


@dataclass(frozen=True)
class Answer:
    """A page of posts with what belongs to it; DataFrames are lazy."""

    posts: DataFrame
    authors: DataFrame
    total: DataFrame | None = None
    groups: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)


def _with_keywords(spark: SparkSession, sf: str, f: fl.PostFilters) -> DataFrame:
    rows = matching(spark, sf, f, ("content",))
    if f.keywords:
        held = t.matches(rows, "id", "content", f.keywords, f.match)
        rows = rows.join(held.select("id"), "id", "left_semi")
    return rows


def answer(spark: SparkSession, sf: str, query: Mapping[str, str], embed: Embedder | None = None) -> Answer:
    """Q1 to Q4: plain search, semantic search (``semantic=true``), image groups (``groupByImage=true``) or topics (``trends=true``).

    Grouping goes before semantic search. If the question cannot be embedded, keywords alone answer it and a warning tells so.
    """
    f = fl.parse(query)
    warn = fl.warnings(f, has_text=bool(t.phrases(f.keywords)) if f.keywords else None)
    facet = authors_of(spark, sf, f)
    rows = _with_keywords(spark, sf, f)
    for flag, kind, least in (("groupByImage", "image", S.IMAGE_SIMILAR), ("trends", "content", S.CONTENT_SIMILAR)):
        if query.get(flag) == "true":
            need = "text IS NOT NULL AND image IS NOT NULL" if kind == "image" else "text IS NOT NULL"
            found = flagged(spark, sf, ["likes", "shares", *TEXTS]).where(need).join(rows.select("id"), "id", "left_semi")
            top = with_vectors(spark, sf, found.orderBy(F.desc("likes"), "id").limit(S.CANDIDATES))
            return Answer(top.select("id", "likes"), facet, groups=v.labelled(v.candidate_groups(top, (DIM, IMAGE_DIM), kind, least), top, kind), warnings=warn)
    if query.get("semantic") == "true" and f.keywords:
        vector: Sequence[float] | None = None
        try:
            vector = embed(", ".join(f.keywords)) if embed else None
        except Exception as e:  # noqa: BLE001 - the embedder is the caller's
            warn.append(f"semantic search is off: {type(e).__name__}")
        free = matching(spark, sf, f, ("content",))
        words = t.ranked(free, "id", "content", f.keywords).orderBy("bm25", "id").limit(S.RETRIEVED)
        lists = [words.select("id", F.row_number().over(Window.orderBy("bm25", "id")).alias("rank"))]
        if vector is not None:
            allowed = live_scores(spark, sf, list(vector))
            if fl.narrows(f):
                allowed = allowed.join(free.select("id"), "id", "left_semi")
            near = v.best_scored(allowed, "id")
            lists.append(near.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank")))
        elif embed is None:
            warn.append("semantic search is off: no embedder")
        fused = v.fused(lists, "id")
        total = fused.agg(F.count("*").alias("total"))
        first = (f.page - 1) * f.page_size
        return Answer(fused.where((F.col("place") > first) & (F.col("place") <= first + f.page_size)).orderBy("place"), facet, total, warnings=warn)
    if f.sort == "relevance" and f.keywords:
        rows = rows.join(t.ranked(posts(spark, sf, ["content"]), "id", "content", f.keywords), "id")
    elif f.sort == "relevance":
        f = fl.parse({**query, "sort": "recent"})
    return Answer(fl.page(rows, f), facet, rows.agg(F.count("*").alias("total")), warnings=warn)
