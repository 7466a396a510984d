"""Streaming over the groups of a partition that is already clustered and sorted."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa


def runs(batch: pa.RecordBatch, keys: Sequence[str]) -> list[tuple[tuple, int, int]]:
    """(key values, first row, row after the last) of each run of equal keys in a batch."""
    n = batch.num_rows
    if n == 0:
        return []
    columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
    change = np.zeros(n, bool)
    change[0] = True
    for c in columns:
        values = c.to_numpy(zero_copy_only=False)
        change[1:] |= values[1:] != values[:-1]
    starts = np.flatnonzero(change)
    return [(tuple(c[int(a)].as_py() for c in columns), int(a), int(b)) for a, b in zip(starts, [*starts[1:], n])]


def by_group(keys: Sequence[str], work: Callable[[tuple, pa.Table], Iterator[pa.RecordBatch]]) -> Callable:
    """A mapInArrow function that calls ``work`` once for each group of a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for batch in batches:
            for key, a, b in runs(batch, keys):
                if key != at and parts:
                    yield from work(at, pa.Table.from_batches(parts))
                    parts = []
                at = key
                parts.append(batch.slice(a, b - a))
        if parts:
            yield from work(at, pa.Table.from_batches(parts))

    return run
