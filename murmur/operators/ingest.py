"""Merging, deduplication and keyed writes, as new tables from old ones.

Plain Parquet has no MERGE: each function gives the table after the write, to be stored beside the old one and swapped in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.operators.order import running


def first_rows(df: DataFrame, key: Sequence[str], order: Sequence) -> DataFrame:
    """One whole row a key: the first in the order given; rows with a null in the key are kept apart."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def merged_sources(keyword: DataFrame, creator: DataFrame, key: str, order: str) -> DataFrame:
    """Both runs' rows by key; the first of a run wins, those of the keyword run first; ``source`` tells which runs had the key.

    Rows with a null or empty key are skipped.
    """
    rows = keyword.withColumn("_run", F.lit(0)).unionByName(creator.withColumn("_run", F.lit(1))).where(F.col(key).isNotNull() & (F.col(key) != ""))
    runs = F.collect_set("_run").over(Window.partitionBy(key))  # at most two values
    place = F.row_number().over(Window.partitionBy(key).orderBy("_run", order))
    one = rows.withColumn("_runs", runs).withColumn("_place", place).where("_place = 1")
    source = F.when(F.size("_runs") == 2, "both").when(F.col("_run") == 0, "keyword").otherwise("creator")
    return one.withColumn("source", source).drop("_run", "_runs", "_place")


def insert_ignore(target: DataFrame, batch: DataFrame, key: str, unique: str, order: str) -> DataFrame:
    """K1: the rows of the batch that an insert would add: a known key or a known (not null) unique value drops a row, the first
    of the batch wins; a null unique value never conflicts."""
    fresh = first_rows(batch, [key], [order])
    own = F.row_number().over(Window.partitionBy(F.coalesce(F.col(unique), F.concat(F.lit("\0"), F.col(key)))).orderBy(order, key))
    fresh = fresh.withColumn("_place", own).where("_place = 1").drop("_place")
    fresh = fresh.join(target.select(key), key, "left_anti")
    return fresh.join(target.where(F.col(unique).isNotNull()).select(F.col(unique).alias("_u")), F.col(unique) == F.col("_u"), "left_anti")


def upsert(target: DataFrame, batch: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """K3: rows of the batch replace those of their key, the last of the batch wins; other rows stay."""
    last = first_rows(batch, key, [F.desc(order)])
    kept = target.join(last.select(*key), list(key), "left_anti")
    return kept.unionByName(last)


def upsert_coalesced(target: DataFrame, batch: DataFrame, key: str, columns: Sequence[str], order: str) -> DataFrame:
    """K4: like ``upsert``, but a null in the batch keeps the stored value."""
    last = first_rows(batch, [key], [F.desc(order)]).select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    rows = target.select(key, *columns).join(last, key, "full")
    return rows.select(key, *[F.coalesce(f"_new_{c}", c).alias(c) for c in columns])


def update_only(target: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """K2: stored rows with the changed columns; keys that are not stored are not added, a null changes nothing."""
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    rows = target.join(new, key, "left")
    return rows.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns])


def insert_missing(target: DataFrame, batch: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """K5: stored rows and those of the batch whose key is not stored."""
    return target.unionByName(first_rows(batch, key, [order]).join(target.select(*key), list(key), "left_anti"))


def delete(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """K6: stored rows whose key is not among the keys."""
    return target.join(keys.select(key), key, "left_anti")


def redacted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """K7: every row with the named columns null, types kept."""
    types = dict(df.dtypes)
    return df.select(*[F.lit(None).cast(types[c]).alias(c) if c in columns else F.col(c) for c in df.columns])


def leaks(df: DataFrame, columns: Sequence[str]) -> int:
    """K7: rows of an export that still hold something in a redacted column."""
    held = F.lit(False)
    for c in columns:
        held |= F.col(c).isNotNull()
    return df.where(held).count()


def batches(df: DataFrame, group: str, order: Sequence[str], size: str, most_rows: int, most_size: int) -> DataFrame:
    """``batch`` numbers within each group such that no batch has more than ``most_rows`` rows or starts beyond a multiple of
    ``most_size`` of the running size; a row larger than that stands with others that start in its stretch."""
    w = Window.partitionBy(group).orderBy(*order)
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretch = F.floor(before / most_size)
    rows = df.withColumn("_stretch", stretch)
    place = F.row_number().over(Window.partitionBy(group, "_stretch").orderBy(*order)) - 1
    return rows.withColumn("batch", F.struct("_stretch", F.floor(place / most_rows).alias("part"))).drop("_stretch")


def remeasured(target: DataFrame, scraped: DataFrame, days: DataFrame, on: str, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(posts, days, authors): X4: what a second look at posts leaves: known ones with their new numbers, new ones added, a capture of each, and
    the authors to score again.

    ``target``, ``scraped``: id, author_id, likes, comments, shares, one row an id; ``days``: post_id, captured_on, captured_at, likes,
    comments, shares. ``on`` is the day and ``at`` the instant of the capture; a second one of a day replaces the first.
    """
    numbers = ["likes", "comments", "shares"]
    updated = update_only(target, scraped, "id", numbers)
    posts = updated.unionByName(scraped.join(target.select("id"), "id", "left_anti").select(*target.columns))
    seen = scraped.select(F.col("id").alias("post_id"), F.lit(on).cast("date").alias("captured_on"), F.lit(at).cast("timestamp").alias("captured_at"), *numbers)
    authors = scraped.select("author_id").where("author_id <> ''").distinct()
    return posts, upsert(days, seen, ["post_id", "captured_on"], "captured_at"), authors


def back_fill_plan(wanted: DataFrame, order: Sequence, available: str, each: int, budget: int) -> DataFrame:
    """``wanted`` with ``asked``: how many records each account may give, in order: at most ``each`` and what is left of ``budget``.

    ``available``: the records an account has; those count against the budget, not those asked for. Accounts that nothing is left
    for have no row. Nothing is fetched: this is the plan.
    """
    rows = wanted.withColumn("_give", F.least(F.col(available), F.lit(each)))
    rows = running(rows, order, "_give", "_before")
    return rows.withColumn("asked", F.least(F.lit(each), F.lit(budget) - F.col("_before"))).where("asked > 0").withColumn("fetched", F.least("asked", "_give")).drop("_give", "_before")
