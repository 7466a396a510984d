"""The k most similar vectors of every vector by a block matrix join.

Vectors are brought together in coarse cells (``vectors.to_cells``). In a cell the int8 product of a tile of
visitors with the tile of members gives every cosine with a quantisation error bound; pairs whose upper bound is
under the threshold, or under the k-th best lower bound of both their rows, are dropped. Survivors are
recomputed in double precision and merged into each row's k best, for visitors and members alike.

Identical vectors are one class: it is joined once, through its smallest id, and its lists are spread over its
members at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm import vectors as V
from murmur.operators.grouped_arrow import runs
from murmur.operators.skew import skew_join
from murmur.sources.shared import stored
from murmur.sources.tables import clustered


def best(rows: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best entries of each row: higher similarity first, then the smaller id."""
    order = np.lexsort((ids, -sims, rows))
    r = rows[order]
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.empty(0, np.int64)
    place = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
    return order[place < k]


class _Members:
    """The members of a cell's part with their k best so far."""

    def __init__(self, ids: np.ndarray, u: np.ndarray, k: int, least: float):
        order = np.argsort(ids)
        keep = np.r_[True, ids[order][1:] != ids[order][:-1]] if len(ids) else np.empty(0, bool)  # rows stored twice
        self.ids, self.u = ids[order[keep]], u[order[keep]]
        self.q, self.k, self.least = V.quantised(self.u), k, least
        self.floor = np.full(len(self.ids), least - 1e-6, np.float32)
        self.rows, self.other, self.sims = np.empty(0, np.int64), np.empty(0, object), np.empty(0)

    def meet(self, ids: np.ndarray, u: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, similarity) of the k best of a tile of visitors; the members' own lists are kept.

        ``own``: the tile is of the members themselves, whose product is symmetric, so one direction is enough.
        """
        q = V.quantised(u)
        upper, margin = V.tile(q, self.q)
        floor = np.full(len(ids), self.least - 1e-6, np.float32)
        passed = upper >= self.least - 1e-6
        for r in np.flatnonzero(passed.sum(1) > self.k + 1):  # one of them may be the row itself
            lower = upper[r] - 2 * margin[r]
            floor[r] = max(floor[r], np.partition(lower, len(lower) - self.k - 1)[len(lower) - self.k - 1] - 1e-6)
        mine = upper >= floor[:, None]
        theirs = np.zeros_like(mine) if own else upper >= self.floor[None, :]
        i, j = np.nonzero((mine | theirs) & passed)
        other = ids[i] != self.ids[j]
        i, j = i[other], j[other]
        sims = V.cosines(u, self.u, i, j)
        near = sims >= self.least
        i, j, sims = i[near], j[near], sims[near]
        if not own and len(i):
            rows, names, all_sims = np.r_[self.rows, j], np.r_[self.other, ids[i]], np.r_[self.sims, sims]
            kept = best(rows, names, all_sims, self.k)
            self.rows, self.other, self.sims = rows[kept], names[kept], all_sims[kept]
            full = np.flatnonzero(np.bincount(self.rows, minlength=len(self.ids)) >= self.k)
            if len(full):
                worst = np.full(len(self.ids), np.inf)
                np.minimum.at(worst, self.rows, self.sims)
                self.floor[full] = worst[full] - 2e-6
        kept = best(i, self.ids[j], sims, self.k)
        return ids[i[kept]], self.ids[j[kept]], sims[kept]

    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.ids[self.rows], self.other, self.sims


def _out(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.tolist(), pa.string()), pa.array(b.tolist(), pa.string()), pa.array(s)], names=["a", "b", "sim"])


def _joined(dim: int, k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, homes, members = None, [], None

        def settle() -> Iterator[pa.RecordBatch]:
            """All members are here: build their block and join it with itself."""
            nonlocal members, homes
            ids, u = np.concatenate([h[0] for h in homes]), np.concatenate([h[1] for h in homes])
            members, homes = _Members(ids, u, k, least), []
            tile = V.tile_rows(len(members.ids))
            for i in range(0, len(members.ids), tile):
                yield _out(*members.meet(members.ids[i : i + tile], members.u[i : i + tile], own=True))

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal members
            if homes:
                yield from settle()
            if members is not None:
                yield _out(*members.lists())
            members = None

        for batch in batches:
            for (cell, part, role), a, b in runs(batch, ["cell", "part", "role"]):
                if (cell, part) != at:
                    yield from close()
                    at = (cell, part)
                ids, u = V.parse(batch.slice(a, b - a), dim)
                if role == 0:
                    homes.append((ids, u))
                    continue
                if homes:
                    yield from settle()
                if members is not None:  # visitors of a part without members meet nobody
                    tile = V.tile_rows(len(members.ids))
                    for i in range(0, len(ids), tile):
                        yield _out(*members.meet(ids[i : i + tile], u[i : i + tile], own=False))
        yield from close()

    return run


def class_lists(rows: DataFrame, n: int, dim: int, k: int, least: float, slack: float | None = None) -> DataFrame:
    """(a, b, sim): for each of the ``n`` distinct vectors (id, x) its k most similar others of at least ``least``."""
    centres = V.place_cells(rows, n, dim)
    if slack is None:
        slack = V.slack_for(centres, *V.partners(rows, n, dim, k, least))
    cells = V.to_cells(rows, centres, dim, slack, V.BLOCK)
    size = 2 * n * (4 * dim + 40)  # with visitors
    found = clustered(cells, "cell", "part", size=size).sortWithinPartitions("cell", "part", "role").mapInArrow(_joined(dim, k, least), "a string, b string, sim double")
    found = found.repartition("a").groupBy("a", "b").agg(F.max("sim").alias("sim"))  # a pair may meet in several cells
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return found.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def similar(df: DataFrame, fields: dict[str, int], k: int = 10, least: float = 0.8, key: str = "id", version: str = "scraped_at", slack: float | None = None) -> DataFrame:
    """(field, id_a, id_b, sim): the list of each row a: its up to k most similar others of cosine ``least`` or more.

    Cosines are rounded to 6 decimals; the smaller id first when equal. ``fields``: vector columns and their
    lengths. A key counts by its latest version. Vectors that are null, of another length, all zero or hold NaN,
    infinity or null have no list and are in none. Columns beside those named play no part. Lists are exact
    but for partners that no cell brings together. How far cells reach is fitted on every run: a sample's true partners are found by brute
    force among all vectors, and the slack is what brings V.MEET of them together; ``slack`` sets it instead.
    """
    names = list(fields)
    known = stored(V.keys(df, fields, key, version), "keys")
    hs = [f"h{i}" for i in range(len(names))]
    live = known.groupBy("id").agg(F.max(F.struct("v", *hs)).alias("s")).select("id", "s.*")  # rows that tie are identical
    live = stored(live, "live")
    results = []
    for i, (field, dim) in enumerate(fields.items()):
        own = live.select("id", "v", F.col(f"h{i}").alias("h")).where(F.col("h").isNotNull())
        classes = stored(own.groupBy("h").agg(F.min(F.struct("id", "v")).alias("s"), F.count("*").alias("n")).select("h", "s.id", "s.v", "n"), f"classes{i}")
        n = classes.count()
        if n == 0:
            continue
        several = classes.where("n > 1").select("h", F.col("id").alias("rep"))
        members = skew_join(own, several, ["h"], classes.where("n > 1").select("h", "n")).select("rep", "id")
        first = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
        few = members.withColumn("i", first).where(F.col("i") <= k + 1).drop("i")
        every = known.where(F.col(f"h{i}").isNotNull()).select("id", "v")
        rows = V.vectors(df, field, i, classes, every, key, version)
        lists = class_lists(rows, n, dim, k, least, slack)
        others = lists.join(few.withColumnRenamed("rep", "b"), "b", "left").select("a", F.coalesce("id", "b").alias("b"), "sim", F.lit(False).alias("own"))
        copies = few.select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("sim"), F.lit(True).alias("own"))
        by_class = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
        marked = others.union(copies).withColumn("r", by_class).withColumn("several", F.max("own").over(Window.partitionBy("a")))
        whole = stored(marked.where(F.col("r") <= k + 1).select("a", "b", "sim", "r", "several"), f"lists{i}")
        # the list of a class of one is its record's; the members of a large class stay where they are
        alone = whole.where((F.col("r") <= k) & ~F.col("several")).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), "sim")
        counts = classes.where("n > 1").select(F.col("id").alias("a"), "n")
        many = skew_join(members.withColumnRenamed("rep", "a"), whole.where("several").select("a", "b", "sim"), ["a"], counts).select(F.col("id").alias("id_a"), F.col("b").alias("id_b"), "sim").where("id_a <> id_b")
        rank = F.row_number().over(Window.partitionBy("id_a").orderBy(F.desc("sim"), "id_b"))
        listed = alone.union(many.withColumn("r", rank).where(F.col("r") <= k).drop("r"))
        results.append(listed.select(F.lit(field).alias("field"), "id_a", "id_b", "sim"))
    if not results:
        return df.sparkSession.createDataFrame([], "field string, id_a string, id_b string, sim double")
    out = results[0]
    for r in results[1:]:
        out = out.union(r)
    return out
