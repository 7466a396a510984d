"""Captures as streams: one row a key, the last capture wins.

``foreachBatch`` writes each micro-batch over the days of the stored table that it touches, as the batch upsert does; a batch that is
run again after a failure gives the same table. ``windowed`` is the append-only form with a watermark.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.operators.ingest import upsert
from murmur.sources.shared import shared_dir, stored
from murmur.sources.tables import table


def file_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table as a stream."""
    schema = table(spark, sf_dir, name).schema
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(schema)
    if os.path.isdir(path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


class KeyedTable:
    """A table that micro-batches are written over, in one folder a batch and day; a day's newest folder holds.

    A batch rewrites only the days it touches. What is there is told by the folders alone: a batch whose write did not end has no
    success mark and counts for nothing, one that is run again replaces itself. With the same ``root`` a restarted stream goes on
    where it stopped.
    """

    def __init__(self, spark: SparkSession, key: Sequence[str], order: str, root: str | None = None, day: str | None = None):
        self.spark, self.key, self.order = spark, list(key), order
        self.root = root or f"{shared_dir(spark)}/murmur-capture-{uuid.uuid4().hex}"
        self.day = F.date_format(F.col(day), "yyyy-MM-dd") if day else F.lit("all")

    def _names(self, path: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def days(self, below: int | None = None) -> dict[str, str]:
        """The folder that holds each day, of batches before ``below``."""
        out: dict[str, str] = {}
        batches = sorted(int(n[1:]) for n in self._names(self.root) if n[:1] == "b" and n[1:].isdigit())
        for b in batches:
            inside = self._names(f"{self.root}/b{b}")
            if (below is None or b < below) and "_SUCCESS" in inside:
                out.update({n[8:]: f"{self.root}/b{b}/{n}" for n in inside if n.startswith("day_key=")})
        return out

    def write(self, batch: DataFrame, number: int) -> None:
        """Write one micro-batch over the stored days it touches; an earlier batch may hold a later capture of a key."""
        batch = stored(batch.withColumn("day_key", self.day), "batch")
        touched = [r["day_key"] for r in batch.select("day_key").distinct().collect()]  # days, not rows
        held = self.days(number)
        old = [held[d] for d in touched if d in held]
        rows = batch
        if old:
            kept = self.spark.read.schema(batch.drop("day_key").schema).parquet(*old)
            rows = batch.unionByName(kept.withColumn("day_key", self.day))
        new = upsert(rows.where(F.lit(False)), rows, self.key, self.order)
        new.write.mode("overwrite").partitionBy("day_key").parquet(f"{self.root}/b{number}")

    def read(self, schema) -> DataFrame:
        """The table as it is now; an empty one before the first batch."""
        paths = list(self.days().values())
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def captured_table(spark: SparkSession, sf_dir: str, name: str, key: Sequence[str], order: str, root: str | None = None, day: str | None = None) -> DataFrame:
    """All files of a table through the stream, until none is left: the last capture of each key; null keys are left out.

    ``day``: a column of the key by whose days the table is stored. With a ``root`` that is given again only new files are read.
    """
    stream = file_stream(spark, sf_dir, name)
    kept = F.lit(True)
    for k in key:
        kept &= F.col(k).isNotNull()
    out = KeyedTable(spark, key, order, root, day)
    run = stream.where(kept).writeStream.foreachBatch(out.write).option("checkpointLocation", f"{out.root}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    return out.read(stream.schema)


def windowed(stream: DataFrame, key: Sequence[str], at: str, late: str = "2 days") -> DataFrame:
    """(key, day, last): daily windows closed once the watermark has passed them; later rows are dropped."""
    rows = stream.withWatermark(at, late)
    columns = [c for c in stream.columns if c not in (*key, at)]
    best = F.max_by(F.struct(*columns), F.col(at)).alias("last")
    return rows.groupBy(F.window(at, "1 day").alias("day"), *key).agg(best).select(*key, F.col("day.start").cast("date").alias("day"), "last.*")
