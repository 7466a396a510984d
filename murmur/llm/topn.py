"""Top N rows of every group by partition lower bounds.

Each partition keeps its own N best rows of every group (one pass over Arrow batches, state of at most N rows
a group) and marks the N-th best: a bound that the N best of the whole group cannot fall below. Only those
rows are shuffled; per group the tightest bound filters them before the survivors are ranked. A group of any
size therefore sends at most N rows a partition to the task that ranks it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: New rows gathered before a partition is reduced to its N best of every group.
CHUNK = 200_000


def _best(rows: pa.Table, n: int) -> tuple[pa.Table, np.ndarray]:
    """The rows sorted by group with at most ``n`` of each, and which of them is a group's n-th."""
    rows = rows.combine_chunks().sort_by([("g", "ascending"), ("ns", "ascending"), ("t", "ascending")])
    g = rows.column("g").combine_chunks().dictionary_encode()
    codes = (g.combine_chunks() if isinstance(g, pa.ChunkedArray) else g).indices.to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.empty(0, np.int64)
    place = np.arange(len(codes)) - np.repeat(first, np.diff(np.r_[first, len(codes)]))
    kept = place < n
    return rows.filter(pa.array(kept)), place[kept] == n - 1


def _local_best(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = reduced = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            # as many new rows as are held: every row is sorted a bounded number of times on average
            if rows >= max(CHUNK, reduced):
                held = [_best(pa.concat_tables(held), n)[0]]
                rows, reduced = 0, held[0].num_rows
        if not held:
            return
        kept, last = _best(pa.concat_tables(held), n)
        yield from kept.append_column("bound", pa.array(last)).to_batches(max_chunksize=CHUNK)

    return run


def top_n(df: DataFrame, group: str, score: str, tie: str, n: int) -> DataFrame:
    """(group, tie, score, rank): the ``n`` rows of each group with the highest score, the smaller tie value first.

    Null groups, null ties and null or NaN scores never count; other columns are ignored, whatever their
    names. Repeated rows count as often as they occur. An empty table gives no rows. Negative zero equals zero.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    value = F.col(score).cast("double")
    rows = df.select(F.col(group).alias("g"), (F.lit(0.0) - value).alias("ns"), F.col(tie).alias("t"))
    rows = rows.where(F.col("g").isNotNull() & F.col("t").isNotNull() & F.col("ns").isNotNull() & ~F.isnan("ns"))
    types = dict(rows.dtypes)
    local = rows.mapInArrow(_local_best(n), f"g {types['g']}, ns double, t {types['t']}, bound boolean")
    key = F.struct("ns", "t")
    tightest = F.min(F.when(F.col("bound"), key)).over(Window.partitionBy("g"))
    kept = local.withColumn("b", tightest).where(F.col("b").isNull() | (key <= F.col("b")))
    rank = F.row_number().over(Window.partitionBy("g").orderBy("ns", "t"))
    return kept.withColumn("r", rank).where(F.col("r") <= n).select(
        F.col("g").alias(group), F.col("t").alias(tie), (F.lit(0.0) - F.col("ns")).alias(score), F.col("r").alias("rank")
    )
