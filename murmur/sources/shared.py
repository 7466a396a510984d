"""Intermediate tables in the folder that all executors share.

A written table cuts lineage without a second evaluation, survives the loss of executors and is read with
column pruning. The folder is the session's ``spark.checkpoint.dir``; where that is unset on a single machine (tests, a
laptop) a temporary folder is made and removed at exit. A cluster must name the folder.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables of this session."""
    global _own
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own is None:
        folder = tempfile.mkdtemp(prefix="murmur-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own = f"file://{folder}"
    return _own


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/murmur-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Remove the intermediate tables written so far, once no result needs them any more; how many there were."""
    n = len(_made)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
