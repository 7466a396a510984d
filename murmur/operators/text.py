"""Full-text search: tokens, phrases, ranking.

A search explodes only the query's own tokens out of each text, so postings that nobody asks for are never shuffled;
``postings`` writes out the whole index for repeated use.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions.stemming import stem, stemmed

#: Okapi parameters.
K1, B = 1.2, 0.75
_GAP = r"[^\p{L}\p{N}]+"
_PY_WORD = re.compile(r"[^\W_]+")


def tokens(text: Column) -> Column:
    """T-1: the lower-cased runs of letters and digits, in order; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _GAP), lambda x: x != "")


def phrases(terms: Sequence[str], stems: bool = True) -> list[list[str]]:
    """T-3: each term as a phrase of tokens; terms without a letter or digit and repeats are left out."""
    out: list[list[str]] = []
    for t in terms:
        words = [w.lower() for w in _PY_WORD.findall(t)]
        words = [stem(w) for w in words] if stems else words
        if words and words not in out:
            out.append(words)
    return out


def _may_be(word: Column, wanted: set[str], stems: bool) -> Column:
    """Whether a word can be (have as its stem) one of ``wanted``. A stem keeps its word's first letter and the second, but for a y that becomes i; words
    that differ there need not be stemmed."""
    if not stems:
        return word.isin(*sorted(wanted))
    two = {w[:2] for w in wanted if len(w) > 1} | {w[0] + "y" for w in wanted if w[1:2] == "i"}
    return F.substring(word, 1, 2).isin(*sorted(two)) | F.substring(word, 1, 1).isin(*sorted(w for w in wanted if len(w) == 1))


def condensed(df: DataFrame, text: str, terms: Sequence[str], stems: bool = True) -> DataFrame:
    """``df`` with all that a search for ``terms`` needs of ``text`` in its place: the number of tokens, and place and word of those that may be the terms'.

    ``matches`` and ``ranked`` take it instead of the text, for the same terms only. It is narrow, so that the version rule can go without texts.
    """
    wanted = {w for p in phrases(terms, stems) for w in p}
    rows = df.withColumn("_tokens", tokens(F.col(text)))
    words = F.filter(F.transform("_tokens", lambda x, i: F.struct(i.alias("pos"), x.alias("token"))), lambda s: _may_be(s["token"], wanted, stems))
    return rows.withColumn(text, F.struct(F.size("_tokens").alias("n"), words.alias("words"))).drop("_tokens")


def _is_condensed(df: DataFrame, text: str) -> bool:
    return isinstance(df.schema[text].dataType, T.StructType)


def _tokens_of(df: DataFrame, key: str, text: str, terms: Sequence[str], stems: bool) -> DataFrame:
    """(k, pos, token, n): places of the terms' tokens in each text, and the text's number of tokens."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    rows = rows if _is_condensed(df, text) else condensed(rows, "t", terms, stems)
    flat = rows.select("k", F.col("t.n").alias("n"), F.explode("t.words").alias("h")).select("k", "h.pos", "h.token", "n")
    if not stems:
        return flat
    wanted = pa.array(sorted({w for p in phrases(terms) for w in p}), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(2).dictionary_encode()
            stems_ = pa.array([stem(w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
            columns = [batch.column(0), batch.column(1), stems_, batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "pos", "token", "n"]).filter(pc.is_in(stems_, value_set=wanted))

    return flat.mapInArrow(run, f"k {dict(flat.dtypes)['k']}, pos int, token string, n int")


def matches(df: DataFrame, key: str, text: str, terms: Sequence[str], match: str = "any", stems: bool = True) -> DataFrame:
    """(key, phrases): rows whose text holds any (all) of the phrases, and how many; T-4, T-5.

    A phrase holds where its tokens stand side by side in order. Without a searchable term nothing matches.
    """
    asked = phrases(terms, stems)
    if not asked:
        return df.select(F.col(key), F.lit(0).cast("long").alias("phrases")).where(F.lit(False))
    places = _tokens_of(df, key, text, terms, stems)
    parts = [F.struct(F.lit(i).alias("p"), F.lit(o).alias("o"), F.lit(w).alias("w"), F.lit(len(p)).alias("m")) for i, p in enumerate(asked) for o, w in enumerate(p)]
    at = places.select("k", "pos", "token", F.explode(F.array(*parts)).alias("x")).where(F.col("x.w") == F.col("token"))
    starts = at.groupBy("k", F.col("x.p").alias("p"), (F.col("pos") - F.col("x.o")).alias("start"), F.col("x.m").alias("m")).agg(F.count("*").alias("n")).where("n = m")
    held = starts.groupBy("k").agg(F.countDistinct("p").alias("phrases"))
    least = len(asked) if match == "all" else 1
    return held.where(F.col("phrases") >= least).select(F.col("k").alias(key), "phrases")


def ranked(df: DataFrame, key: str, text: str, terms: Sequence[str], stems: bool = True) -> DataFrame:
    """(key, bm25): T-6: Okapi BM25 over the terms' tokens, negated so that the best is smallest; only rows with a token.

    Counts and lengths are those of all rows of ``df``. A token in more than half of the rows has a tiny positive weight.
    """
    wanted = {w for p in phrases(terms, stems) for w in p}
    if not wanted:
        return df.select(F.col(key), F.lit(0.0).alias("bm25")).where(F.lit(False))
    size = F.col(text)["n"] if _is_condensed(df, text) else F.size(tokens(F.col(text)))
    stats = df.agg(F.count("*").alias("docs"), F.avg(size).alias("mean"))  # one row
    tf = _tokens_of(df, key, text, terms, stems).groupBy("k", "token").agg(F.count("*").alias("tf"), F.first("n").alias("n"))
    df_ = tf.groupBy("token").agg(F.count("*").alias("df"))  # a row a query token
    rows = tf.join(F.broadcast(df_), "token").crossJoin(F.broadcast(stats))
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    return rows.groupBy("k").agg((-F.sum(part)).alias("bm25")).select(F.col("k").alias(key), "bm25")


def postings(df: DataFrame, key: str, text: str, stems: bool = True) -> DataFrame:
    """(token, key, tf, places): the whole index; T-2. Words are stemmed batch by batch where they are, so no word is brought together."""
    flat = df.select(F.col(key).alias("k"), F.posexplode(tokens(F.col(text))).alias("pos", "word"))
    flat = flat.withColumn("token", stemmed("word")) if stems else flat.withColumnRenamed("word", "token")
    return flat.groupBy("token", "k").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("places")).select("token", F.col("k").alias(key), "tf", "places")


def maintained(index: DataFrame, before: DataFrame, after: DataFrame, key: str, text: str, stems: bool = True) -> DataFrame:
    """X6, T-8: the index of ``after`` from that of ``before`` (both key, text; one row a key).

    Only rows that are new, gone or of another text are touched; other changes to a row leave the index as it is.
    """
    old, new = before.select(F.col(key).alias("_k"), F.col(text).alias("_old")), after.select(F.col(key).alias("_n"), F.col(text).alias("_new"))
    both = old.join(new, F.col("_k") == F.col("_n"), "full").where(~F.col("_old").eqNullSafe(F.col("_new")) | F.col("_k").isNull() | F.col("_n").isNull())
    gone = both.where("_k IS NOT NULL").select(F.col("_k").alias(key))
    added = both.where("_n IS NOT NULL").select(F.col("_n").alias(key), F.col("_new").alias(text))
    return index.join(gone, key, "left_anti").unionByName(postings(added, key, text, stems))


def integrity(index: DataFrame, df: DataFrame, key: str, text: str, stems: bool = True) -> DataFrame:
    """(postings, missing, stray): T-8: one row: the postings that the texts give, and how many of them the index lacks or has besides."""
    row = lambda d, side: d.select("token", key, "places", F.lit(side).alias("s"))
    both = row(postings(df, key, text, stems), 1).unionByName(row(index, 2)).groupBy("token", key, "places")
    sides = both.agg(F.count_if(F.col("s") == 1).alias("a"), F.count_if(F.col("s") == 2).alias("b"))
    least = lambda x, y: F.coalesce(F.sum(F.greatest(F.col(x) - F.col(y), F.lit(0))), F.lit(0))
    return sides.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("postings"), least("a", "b").alias("missing"), least("b", "a").alias("stray"))
