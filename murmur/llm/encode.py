"""Token ids of a whole corpus by content-defined chunks that are encoded once.

A rolling hash over the last WINDOW characters cuts a text wherever its value falls into a small set, so equal
passages of different documents yield equal chunks. Only the chunks' hashes and places are shuffled to find those that occur
again. A document's stretches between such chunks are encoded where the document is, a repeated chunk at its first place
only; its ids fill the holes that the other places leave.
A cut just before a single space between two characters that are not white space is a word boundary for the tokenizer's
splitting pattern in any context and needs no repair; around any other cut beside a repeated chunk the stretch between the
nearest such boundaries is encoded again until it agrees with the tokens on both its sides, so the ids equal those of
encoding each text whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators.skew import skew_join
from murmur.sources.shared import stored

#: Where the vocabulary files of public tokenizers are.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: Characters of the rolling hash; one in so many spaces, and in so many other places, is a cut; characters hashed at once.
WINDOW, SPACES, PLACES, AT_ONCE = 12, 32, 192, 1 << 20
#: The splitting pattern of byte_bpe_50k (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=4)
def tokenizer(folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
    """(encoding, lengths): the tokenizer of a rank file and the byte length of every token."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


#: White space up to U+3000, then nothing.
_WHITE = np.zeros(0x3002, bool)
_WHITE[[*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


def _white(c: np.ndarray) -> np.ndarray:
    """Which code points are white space."""
    return _WHITE[np.minimum(c, 0x3001)]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def safe_places(c: np.ndarray) -> np.ndarray:
    """Positions of single spaces between characters that are not white space."""
    at = np.flatnonzero(c[1:-1] == 32) + 1
    return at[~_white(c[at - 1]) & ~_white(c[at + 1])]


def _places(c: np.ndarray) -> np.ndarray:
    """Where code points are cut, if what is before the first and after the last does not matter: by the characters near a place only."""
    if len(c) <= WINDOW + 1:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        f = np.uint64(0x9E3779B97F4A7C15)
        one = c.astype(np.uint64) + np.uint64(1)
        two = one[1:] + one[:-1] * f  # of two characters, then of four, eight, twelve
        four = two[2:] + two[:-2] * f**2
        eight = four[4:] + four[:-4] * f**4
        h = eight[4:] + four[:-8] * f**8
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)
    before = h[:-1]  # of the characters before each place from WINDOW on
    safe = safe_places(c)
    safe = safe[safe >= WINDOW]
    safe = safe[before[safe - WINDOW] % np.uint64(SPACES) == 0]
    dense = np.flatnonzero(c[WINDOW:] > 0x2E7F)
    dense = dense[before[dense] % np.uint64(PLACES) == 1] + WINDOW
    return np.union1d(safe, dense)


def cuts_of(texts: list[str]) -> list[np.ndarray]:
    """Where each text is cut; short texts are hashed together, long ones in stretches, which changes nothing."""
    out: list[np.ndarray] = []
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= AT_ONCE):
            size += len(texts[b])
            b += 1
        c = _points("".join(texts[a:b]))
        at = []
        for s in range(0, len(c), AT_ONCE):
            low = max(0, s - WINDOW - 1)
            found = _places(c[low : s + AT_ONCE + 1]) + low
            at.append(found[(found >= s) & (found < s + AT_ONCE)])
        places = np.concatenate(at) if at else np.empty(0, np.int64)
        ends = np.cumsum([len(t) for t in texts[a:b]])
        of = np.searchsorted(ends, places, side="right")
        starts = np.r_[0, ends[:-1]]
        inner = (places - starts[of] > WINDOW) & (places < ends[of] - 1)  # what is near belongs to the same text
        places, of = places[inner] - starts[of[inner]], of[inner]
        out += np.split(places, np.searchsorted(of, np.arange(1, b - a)))
        a = b
    return out


def cuts(text: str) -> list[int]:
    """Where a text is cut."""
    return cuts_of([text])[0].tolist()


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, a, b, h, safe, after): place and hash of every chunk; the cut at ``a`` (``safe``) or ``b`` (``after``) needs no repair."""
    import xxhash

    for batch in batches:
        kept = [(i, t) for i, t in enumerate(batch.column(1).to_pylist()) if t]
        rows, first, last, hashes, safe, after = [], [], [], [], [], []
        for (i, text), at in zip(kept, cuts_of([t for _, t in kept])):
            ends = [0, *at.tolist(), len(text)]
            rows += [i] * (len(ends) - 1)
            first += ends[:-1]
            last += ends[1:]
            sure = [True, *(text[a] == " " for a in ends[1:-1]), True]  # only safe spaces are cut, beside dense scripts
            safe += sure[:-1]
            after += sure[1:]
            hashes += [xxhash.xxh3_128_digest(text[a:b].encode("utf-8", "surrogatepass")) for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(hashes, pa.binary()), pa.array(safe, pa.bool_()), pa.array(after, pa.bool_())], names=["d", "a", "b", "h", "safe", "after"])


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


def _whole(folder: str, name: str):
    """(d, ids) of texts without repeated chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, _ = tokenizer(folder, name)
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                ids = [t.encode_ordinary(x) if x else [] for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["d", "ids"])

    return run


def _first(folder: str, name: str):
    """(h, ids) of the repeated chunks whose first place is in a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, _ = tokenizer(folder, name)
        for batch in batches:
            hashes, ids = [], []
            for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for p in places:
                    if p["first"]:
                        hashes.append(p["h"])
                        ids.append(_packed(t.encode_ordinary(text[p["a"] : p["b"]])))
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(ids, pa.binary())], names=["h", "ids"])

    return run


def _around(folder: str, name: str):
    """(d, a, safe, ids) of a text's stretches between its repeated chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, _ = tokenizer(folder, name)
        for batch in batches:
            rows, at, safe, ids = [], [], [], []
            for i, (text, places) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                done, sure = 0, True
                for p in [*sorted(places, key=lambda p: p["a"]), {"a": len(text), "b": len(text), "after": True}]:
                    if p["a"] > done:
                        rows.append(i)
                        at.append(done)
                        safe.append(sure)
                        ids.append(_packed(t.encode_ordinary(text[done : p["a"]])))
                    done, sure = p["b"], p["after"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(at, pa.int32()), pa.array(safe, pa.bool_()), pa.array(ids, pa.binary())], names=["d", "a", "safe", "ids"])

    return run


def joined(parts: list[np.ndarray], folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> np.ndarray:
    """The ids of a text from the ids of its chunks, repaired at the cuts."""
    ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
    if len(parts) < 2:
        return ids
    t, lengths = tokenizer(folder, name)
    ends = np.cumsum(lengths[ids])  # byte offsets after each token
    text = t.decode_bytes(ids.tolist()).decode("utf-8", "surrogatepass")
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
    at = np.r_[0, np.cumsum(size)]  # byte offset of each character
    safe = at[safe_places(c)]
    bounds = ends[np.cumsum([len(p) for p in parts])[:-1] - 1]
    bad = bounds[~np.isin(bounds, safe)]
    if not len(bad):
        return ids
    stops = np.r_[0, safe, ends[-1]]
    data = text.encode("utf-8", "surrogatepass")
    starts = np.r_[0, ends]  # token boundaries
    out, done = [], 0
    i = 0
    while i < len(bad):
        left = int(np.searchsorted(stops, bad[i], side="left")) - 1
        right = int(np.searchsorted(stops, bad[i], side="right"))
        while left > 0 and starts[np.searchsorted(starts, stops[left])] != stops[left]:
            left -= 1
        while right < len(stops) - 1 and starts[np.searchsorted(starts, stops[right])] != stops[right]:
            right += 1
        while i < len(bad) and bad[i] < stops[right]:
            i += 1
        a, b = int(np.searchsorted(starts, stops[left])), int(np.searchsorted(starts, stops[right]))
        if a < done:  # the stretch before ends here: it is one with this
            a = done
        out.append(ids[done:a])
        out.append(np.array(t.encode_ordinary(data[int(starts[a]) : int(stops[right])].decode("utf-8", "surrogatepass")), np.int64))
        done = b
    out.append(ids[done:])
    return np.concatenate(out)


def _assembled(folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(1).to_pylist():
                held = [np.frombuffer(p["ids"], np.int32) for p in parts]
                out.append(np.concatenate(held) if all(p["safe"] for p in parts) else joined([x.astype(np.int64) for x in held], folder, name).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["d", "ids"])

    return run


def corpus_ids(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, ids): the token ids of each row's text, equal to encoding it whole, without special tokens.

    Null and empty texts have an empty list. Keys must be unique; rows with a null key are left out. Texts of special tokens are
    ordinary text. Columns beside those named play no part. An empty table gives no rows.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("d"), F.col(text).alias("x"))
    kind = dict(rows.dtypes)["d"]
    chunks = stored(rows.mapInArrow(_marked, f"d {kind}, a int, b int, h binary, safe boolean, after boolean"), "chunks")
    repeated = stored(chunks.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("d", "a")).alias("one")).where("n > 1"), "repeated")
    places = skew_join(chunks, repeated.select("h", "one"), ["h"], repeated.select("h", "n"))
    places = stored(places.withColumn("first", (F.col("d") == F.col("one.d")) & (F.col("a") == F.col("one.a"))).drop("one"), "places")
    lists = places.groupBy("d").agg(F.collect_list(F.struct("a", "b", "h", "first", "after")).alias("p"))  # as long as its text
    both = rows.join(lists, "d", "left").select("d", "x", "p")
    alone, others = both.where("p IS NULL"), both.where("p IS NOT NULL")
    first = others.where(F.exists("p", lambda p: p["first"])).mapInArrow(_first(folder, name), "h binary, ids binary")
    pieces = others.mapInArrow(_around(folder, name), f"d {kind}, a int, safe boolean, ids binary")
    filled = skew_join(places.select("d", "a", "safe", "h"), first, ["h"], repeated.select("h", "n"))
    parts = pieces.unionByName(filled.select("d", "a", "safe", "ids"))
    made = parts.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("a", "safe", "ids"))).alias("p")).mapInArrow(_assembled(folder, name), f"d {kind}, ids array<int>")
    return alone.select("d", "x").mapInArrow(_whole(folder, name), f"d {kind}, ids array<int>").union(made).select(F.col("d").alias(key), "ids")


def token_counts(df: DataFrame, columns: list[str], text: str, size: str = "tokens", folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """``columns`` and the number of tokens of each text, 0 if null or empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, _ = tokenizer(folder, name)
        for batch in batches:
            n = [len(t.encode_ordinary(x)) if x else 0 for x in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(columns))], pa.array(n, pa.int64())], names=[f"c{i}" for i in range(len(columns) + 1)])

    rows = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col(text).alias(f"c{len(columns)}"))
    types = dict(rows.dtypes)
    out = rows.mapInArrow(run, ", ".join(f"c{i} {types[f'c{i}']}" for i in range(len(columns))) + f", c{len(columns)} long")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], F.col(f"c{len(columns)}").alias(size))
