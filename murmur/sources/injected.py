"""Remote functions that the caller injects: embedding, description, transcription.

Nothing here reaches a network. The function is called in batches inside the tasks; what it cannot do is a null with a reason, never
a failed query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def applied(df: DataFrame, key: str, column: str, function: Callable[[list[str]], Sequence], result: str, size: int = 100) -> DataFrame:
    """(key, value, status): S9 to S13: ``function`` over the non-null values in batches of ``size``.

    ``result``: the type of a value. The function gives one value (or None) for each input, in order. If it raises, the batch's
    rows have a null value and status ``unavailable: ...``; None has status ``none``, others ``done``. Null inputs are not sent
    and have status ``skipped``.
    """
    rows = df.select(F.col(key).alias("k"), F.col(column).cast("string").alias("x"))
    kind = dict(rows.dtypes)["k"]
    schema = f"k {kind}, value {result}, status string"
    arrow = to_arrow_type(rows.select(F.lit(None).cast(result).alias("v")).schema["v"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            values: list = [None] * len(texts)
            status = ["skipped" if t is None else "none" for t in texts]
            asked = [i for i, t in enumerate(texts) if t is not None]
            for a in range(0, len(asked), size):
                part = asked[a : a + size]
                try:
                    got = list(function([texts[i] for i in part]))
                    if len(got) != len(part):
                        raise ValueError("another number of values than inputs")
                except Exception as e:  # noqa: BLE001 - whatever the remote side raises
                    for i in part:
                        status[i] = f"unavailable: {type(e).__name__}"
                    continue
                for i, v in zip(part, got):
                    values[i] = v
                    status[i] = "none" if v is None else "done"
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, type=arrow), pa.array(status)], names=["k", "value", "status"])

    return rows.mapInArrow(run, schema).select(F.col("k").alias(key), "value", "status")
