"""A mixture of sources to target shares by Poisson replication.

The rate of a source is its target size over its size. Each document is used a number of times drawn from a
Poisson distribution, cut off at the source's cap, whose mean is that rate; the draw inverts the distribution at a
uniform number hashed from the document's key, so it is the same on every run and needs no state. Documents are exploded by
their count and shuffled by the hash of key and copy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.operators.skew import skew_join
from murmur.sources.shared import stored

#: Rates are sent to every task for up to this many sources; those of more sources are joined.
BROADCAST_SOURCES = 10_000


def normal_source(column: str) -> Column:
    """Sources compare without white space at their ends and in lower case."""
    return F.lower(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))


def _cut_mean(rate: float, cap: int) -> float:
    """The mean of a Poisson number of mean ``rate``, cut off at ``cap``."""
    p, below, mean = math.exp(-rate), 0.0, 0.0
    for k in range(cap):
        mean += k * p
        below += p
        p *= rate / (k + 1)
    return mean + cap * (1 - below)


def poisson_rate(mean: float, cap: int) -> float | None:
    """The Poisson mean whose cut-off mean is ``mean``; None where only the cap itself reaches it."""
    if mean >= cap:
        return None
    low, high = 0.0, 1.0
    while _cut_mean(high, cap) < mean and high < 700:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _cut_mean(mid, cap) < mean else (low, mid)
    return high


def steps(mean: float, cap: int) -> list[float]:
    """P(count <= k) for k below the cap; a uniform number above so many of them is a count."""
    rate = poisson_rate(mean, cap)
    if rate is None:
        return [-1.0] * cap
    p, total, out = math.exp(-rate), 0.0, []
    for k in range(cap):
        total += p
        out.append(total)
        p *= rate / (k + 1)
    return out


def plan(sizes: DataFrame, source: str, size: str, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, size, total, rate): one row a source of ``targets``.

    ``sizes``: documents with their sizes. ``total`` is the size of all documents, that of the mixture; ``rate`` the mean
    number of uses. A source without
    documents has size 0. Documents of sources that are null or not in ``targets`` count in the total only.
    """
    per = sizes.groupBy(normal_source(source).alias("s")).agg(F.sum(size).alias("n"))
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    t = targets.groupBy(normal_source("source").alias("s")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = t.join(per, "s", "left").crossJoin(total)  # the total is one row
    size_ = F.coalesce(F.col("n"), F.lit(0))
    want = F.col("target_share") * F.col("total")
    return rows.select(
        F.col("s").alias("source"), "target_share", "max_repeats", size_.alias("size"), "total", F.when(size_ > 0, F.least(want / size_, F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0)).alias("rate")
    )


def repeats(plan_: DataFrame) -> DataFrame:
    """(source, steps): the steps of each source of a plan that is used at all, computed in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, rates, caps = (batch.column(i).to_pylist() for i in range(3))
            made = [steps(r, int(c or 0)) for r, c in zip(rates, caps)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(made, pa.list_(pa.float64()))], names=["source", "steps"])

    used = plan_.where("source IS NOT NULL AND rate > 0").select("source", "rate", F.col("max_repeats").cast("long"))
    return used.mapInArrow(run, "source string, steps array<double>")


def replicated(docs: DataFrame, key: str, source: str, size: str, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(key, source, size, times): how often the mixture uses each document of a source in ``targets`` that is used at all."""
    rows = docs.select(F.col(key).alias("k"), normal_source(source).alias("source"), F.col(size).alias("n"))
    table = stored(repeats(plan(docs, source, size, targets)), "rates")
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(table), "source")
    else:
        rows = skew_join(rows, table, ["source"], rows.where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("docs")), "docs")
    draw = (F.shiftrightunsigned(F.xxhash64("k", F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    rows = rows.withColumn("u", draw).withColumn("times", F.size(F.filter("steps", lambda x: F.col("u") > x)))
    return rows.select(F.col("k").alias(key), "source", F.col("n").alias(size), "times")


def mixture(docs: DataFrame, key: str, source: str, size: str, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(key, source, size, copy): the mixture in its shuffled order, copies numbered from 1.

    A document of rate r is used about r times, never more than the source's max_repeats. Documents without a source in
    ``targets`` are not used; a repeated key draws the same number. No documents give no rows.
    """
    used = replicated(docs, key, source, size, targets, seed).where("times > 0")
    copies = used.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return copies.orderBy(F.xxhash64(key, "copy", F.lit(seed + 1)), key, "copy").select(key, "source", size, "copy")


def report(docs: DataFrame, key: str, source: str, size: str, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(source, target_share, max_repeats, size, used, share, capped): what the mixture reaches for each source.

    ``capped``, read off the replicated documents: every one of them is used max_repeats times and together they stay below the
    source's target size. A source without documents uses nothing and is capped unless its target is 0.
    """
    times = replicated(docs, key, source, size, targets, seed)
    used = times.groupBy("source").agg(F.sum(F.col(size) * F.col("times")).alias("used"), F.min("times").alias("fewest"))
    used = stored(used, "used")  # one row a source
    rows = plan(docs, source, size, targets).join(used, "source", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    all_used = used.agg(F.sum("used").alias("sum_used"))
    share = F.coalesce(F.col("used") / F.col("sum_used"), F.lit(0.0))
    exhausted = F.coalesce(F.col("fewest") >= F.col("max_repeats"), F.lit(True))  # no documents of any size: none is left to use
    capped = exhausted & (F.col("used") < F.col("target_share") * F.col("total"))
    return rows.crossJoin(all_used).select("source", "target_share", "max_repeats", "size", "used", F.round(share, 6).alias("share"), capped.alias("capped"))
