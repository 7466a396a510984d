"""Texts as vectors of hashed weighted features.

A word's weight is its frequency in the text, damped, times the logarithm of the inverse share of texts that hold it. Those counts are
taken over all texts, in BUCKETS hashed cells, so that the table that goes to every task has a fixed size. Weighted words are
added with a hashed sign into ``dim`` places and the result is scaled to length one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells in which the texts that hold a word are counted: at most so many rows reach the driver.
BUCKETS = 1 << 18


def _words(text: str | None) -> Counter:
    import regex

    return Counter(regex.findall(r"[\p{L}\p{N}]+", text.lower())) if text else Counter()


def _hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def text_counts(df: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """(texts that hold a word of each cell, texts with a word), over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, cache = np.zeros(BUCKETS, np.int64), 0, {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                words = _words(t)
                texts += bool(words)
                cells = {cache.setdefault(w, _hash(w) % BUCKETS) for w in words}
                held[list(cells)] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[texts, held[at]])], names=["b", "n"])

    out, texts = np.zeros(BUCKETS, np.int64), 0
    for r in df.select(F.col(text)).mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        if r["b"] < 0:
            texts = r["n"]
        else:
            out[r["b"]] = r["n"]
    return out, texts


def text_vectors(df: DataFrame, key: str, text: str, version: str, dim: int = 128, least_words: int = 30) -> DataFrame:
    """(key, x, version): the vector of each row's text; null for texts of fewer than ``least_words`` words.

    All rows come out, so that a later version without words still counts as the latest.
    """
    held, texts = text_counts(df, text)
    shared = df.sparkSession.sparkContext.broadcast(np.log((texts + 1) / (held + 1)).astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, cache = shared.value, {}
        for batch in batches:
            out: list[np.ndarray | None] = []
            for t in batch.column(2).to_pylist():
                words = _words(t)
                x = None
                if sum(words.values()) >= least_words:
                    x = np.zeros(dim, np.float32)
                    for w, n in words.items():
                        h = cache.get(w)
                        if h is None:
                            h = cache[w] = _hash(w)
                        x[(h >> 20) % dim] += (1 if h >> 63 else -1) * (1 + np.log(n)) * weight[h % BUCKETS]
                    size = float(np.sqrt(x @ x))
                    x = x / size if size else None
                out.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float32())), batch.column(1)], names=["k", "x", "v"])

    rows = df.select(F.col(key).alias("k"), F.col(version).alias("v"), F.col(text).alias("t"))
    types = dict(rows.dtypes)
    return rows.mapInArrow(run, f"k {types['k']}, x array<float>, v {types['v']}").select(F.col("k").alias(key), "x", F.col("v").alias(version))
