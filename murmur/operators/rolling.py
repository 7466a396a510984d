"""Totals over trailing periods by segment trees.

The days of an entity are split into shards of 2^SHARD days. A tree of each (entity, shard) stores, for every
aligned block of 2^level days that holds a value, its sum and count: one row a node, built by exploding a
day's value into its ancestors and adding up. A trailing period of any day is a union of O(log) such blocks, so a
query is an equi-join of (entity, block) keys. A late correction adds its difference to the ancestors of one
day (``correct``) and leaves all other nodes as they are.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days of a shard as a power of two; no node is larger.
SHARD = 10


def day_number(day: Column) -> Column:
    """Days since 1970-01-01."""
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def _levels(longest: int) -> int:
    return min(SHARD, max(1, longest).bit_length() - 1)


def tree(values: DataFrame, entity: Sequence[str], day: str, value: str, longest: int) -> DataFrame:
    """Nodes (entity..., shard, level, node, total, days) of the trees that periods of up to ``longest`` days need.

    ``values``: any number of rows a day. Null days and null values are no activity; ``days`` counts the values.
    """
    d = day_number(F.col(day))
    rows = values.where(F.col(day).isNotNull() & F.col(value).isNotNull()).select(*entity, d.alias("_d"), F.col(value).alias("_v"))
    ancestors = F.explode(F.sequence(F.lit(0), F.lit(_levels(longest)))).alias("level")
    nodes = rows.select(*entity, "_d", "_v", ancestors).withColumn("node", F.expr("shiftright(_d, level)"))
    shard = F.shiftright("_d", SHARD).alias("shard")
    return nodes.groupBy(*entity, shard, "level", "node").agg(F.sum("_v").alias("total"), F.count("_v").alias("days"))


def correct(nodes: DataFrame, changes: DataFrame, entity: Sequence[str], day: str, change: str, longest: int, added_days: str | None = None) -> DataFrame:
    """The nodes after late corrections: each change is added to the ancestors of its day only.

    ``added_days``: a column with the number of values a change adds (0 where it only alters one; the default).
    """
    delta = tree(changes, entity, day, change, longest)
    if added_days is None:
        delta = delta.withColumn("days", F.lit(0).cast("long"))
    else:
        counts = tree(changes, entity, day, added_days, longest).select(*entity, "shard", "level", "node", F.col("total").cast("long").alias("_added"))
        delta = delta.join(counts, [*entity, "shard", "level", "node"]).withColumn("days", F.col("_added")).drop("_added")
    return nodes.unionByName(delta).groupBy(*entity, "shard", "level", "node").agg(F.sum("total").alias("total"), F.sum("days").alias("days"))


def _blocks(residue: int, length: int, top: int) -> list[tuple[int, int]]:
    """(level, node) of the aligned blocks that make up the ``length`` days up to day ``residue``.

    Climbing the levels, an odd left end or an even right end is a block of its own.
    """
    out, left, right = [], residue - length + 1, residue
    for level in range(top):
        if left <= right and left & 1:
            out.append((level, left))
            left += 1
        if left <= right and not right & 1:
            out.append((level, right))
            right -= 1
        left, right = left >> 1, right >> 1
    return out + [(top, node) for node in range(left, right + 1)]


def cover(last: Column, length: int) -> Column:
    """The aligned blocks that make up the ``length`` days up to ``last``: array of (level, node).

    Which blocks these are depends on ``last`` only by its residue modulo the largest block, so they are a
    constant table, looked up and shifted.
    """
    top = _levels(length)
    table = [[{"l": a, "n": b} for a, b in _blocks(r, length, top)] for r in range(1 << top)]
    known = F.from_json(F.lit(json.dumps(table)), "array<array<struct<l:int,n:int>>>")
    base = F.shiftright(last, top)
    mine = F.get(known, last.bitwiseAND(F.lit((1 << top) - 1)))
    return F.transform(mine, lambda b: F.struct(b["l"].alias("level"), (b["n"] + F.call_function("shiftleft", base, F.lit(top) - b["l"])).alias("node")))


def trailing(nodes: DataFrame, dates: DataFrame, entity: Sequence[str], day: str, periods: Sequence[int], repeated: bool = True) -> DataFrame:
    """(entity..., day, total_<n>, average_<n> ...) of each row of ``dates`` and each period of n days.

    A day without activity has total 0; averages are the total over the n days of the period. Entities compare
    null-safe, so a null entity is one of its own. ``repeated``: whether a row of ``dates`` may occur twice; if not, a shuffle less.
    """
    asked = dates.select(*entity, day)
    asked = asked.distinct() if repeated else asked
    parts = F.array(*[F.struct(F.lit(n).alias("period"), cover(day_number(F.col(day)), n).alias("blocks")) for n in periods])
    probe = asked.select(*entity, day, F.explode(parts).alias("_p")).select(*entity, day, F.col("_p.period").alias("period"), F.explode("_p.blocks").alias("_b"))
    probe = probe.select(*entity, day, "period", F.col("_b.level").alias("level"), F.col("_b.node").alias("node"))
    probe = probe.withColumn("shard", F.expr(f"shiftright(node, {SHARD} - level)"))
    keys = [*entity, "shard", "level", "node"]
    same = [F.col(f"q.{k}").eqNullSafe(F.col(f"t.{k}")) if k in entity else F.col(f"q.{k}") == F.col(f"t.{k}") for k in keys]
    joined = probe.alias("q").join(nodes.alias("t"), same, "left")
    total = lambda n: F.coalesce(F.sum(F.when(F.col("q.period") == n, F.col("t.total"))), F.lit(0))
    aggs = []
    for n in periods:
        aggs += [total(n).alias(f"total_{n}"), (total(n) / n).alias(f"average_{n}")]
    return joined.groupBy(*[F.col(f"q.{c}").alias(c) for c in (*entity, day)]).agg(*aggs)
