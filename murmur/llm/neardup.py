"""Near-duplicate texts by a generalised pigeonhole over sketch coordinates.

A text becomes the set of its runs of consecutive words and this set a sketch of COORDINATES min-hashes, so that two
texts of overlap J differ in about (1 - J) of the coordinates. A coordinate's bits stand or fall together and so
always share a partition; coordinates whose values agree on more pairs of texts than chance are put together too. By the
pigeonhole principle two sketches that differ in at most D coordinates differ, in one partition i, in at most t_i, for any
thresholds with sum of (t_i + 1) = D + 1; t_i = -1 leaves a partition out. The thresholds are allocated by dynamic
programming on estimated candidate counts, which second-moment sketches over all texts give for every partition and
threshold. Probing a partition of r coordinates at threshold t takes one key for each choice of r - t coordinates.

Texts with one word sequence are one class and are compared once. Candidates that meet under a key pass a 128-bit
sketch test in the join and are then verified exactly on the sets of both texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators.versions import version_of
from murmur.sources.shared import stored
from murmur.sources.tables import spread

#: Coordinates of a sketch, coordinates of a partition, and the chance to miss a pair exactly at the threshold.
COORDINATES, WIDTH, MISS = 112, 4, 0.01
#: Classes of one key in one block of the join; a key is heavy if it holds more than a block and a HEAVY-th of all classes.
BLOCK, HEAVY = 4096, 2048
#: Cells of a second-moment sketch and bits of the test sketch.
MOMENT_CELLS, TEST_BITS = 1024, 128

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _seeds(n: int, salt: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 20)) * _M1) | np.uint64(1)


def word_runs(texts: list[str | None], run: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(rows, starts, hashes, words): the texts of at least ``least_words`` words, and the sorted set of hashes of each
    one's runs of ``run`` words, as a flat array with its starts. Words: runs of letters and digits of the lower-cased text."""
    import regex
    import xxhash

    find = regex.compile(r"[\p{L}\p{N}]+").findall
    cache: dict[str, int] = {}
    rows, lengths, codes, joined = [], [], [], []
    for i, t in enumerate(texts):
        if not t:
            continue
        words = find(t.lower())
        if len(words) < max(least_words, run):
            continue
        for w in words:
            c = cache.get(w)
            if c is None:
                c = cache[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            codes.append(c)
        rows.append(i)
        lengths.append(len(words))
        joined.append(" ".join(words).encode("utf-8", "surrogatepass"))
    if not rows:
        return np.empty(0, np.int64), np.zeros(1, np.int64), np.empty(0, np.uint64), []
    flat = np.array(codes, np.uint64)
    h = np.zeros(len(flat) - run + 1, np.uint64)
    for k in range(run):
        h = mix(h * _M1 + flat[k : len(flat) - run + 1 + k])
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(rows)), lengths)[: len(h)]
    inside = np.arange(len(h)) + run <= ends[doc]
    h, doc = h[inside], doc[inside]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
    h, doc = h[new], doc[new]
    starts = np.r_[np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]), len(h)]
    return np.array(rows), starts, h, joined


def sketch(starts: np.ndarray, hashes: np.ndarray, n: int = COORDINATES) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, test): 16-bit min-hash values of each set, and its TEST_BITS one-bit min-hashes as two 64-bit words."""
    total = n + TEST_BITS
    seeds = _seeds(total, 3)
    low = np.empty((len(starts) - 1, total), np.uint64)
    for k in range(total):
        x = hashes * seeds[k]
        x ^= x >> np.uint64(29)
        x *= _M2
        low[:, k] = np.minimum.reduceat(x, starts[:-1]) if len(hashes) else 0
    low = mix(low)
    bits = (low[:, n:] >> np.uint64(17)) & np.uint64(1)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    test = np.stack([(bits[:, :64] * weights).sum(1, dtype=np.uint64), (bits[:, 64:] * weights).sum(1, dtype=np.uint64)], 1)
    return (low[:, :n] & np.uint64(0xFFFF)).astype(np.uint16), test


def _sketched(run: int, least_words: int):
    """(id, v, cls, sk, t0, t1) of every row; cls, 128 bits of the word sequence, is null for texts that are too short."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            n = batch.num_rows
            rows, starts, hashes, joined = word_runs(batch.column(2).to_pylist(), run, least_words)
            cls: list[bytes | None] = [None] * n
            sk: list[bytes | None] = [None] * n
            t = np.zeros((n, 2), np.int64)
            if len(rows):
                coordinates, test = sketch(starts, hashes)
                t[rows] = test.view(np.int64)
                for r, j, c in zip(rows.tolist(), joined, coordinates):
                    cls[r], sk[r] = xxhash.xxh3_128_digest(j), c.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cls, pa.binary()), pa.array(sk, pa.binary()), pa.array(t[:, 0]), pa.array(t[:, 1])], names=["id", "v", "cls", "sk", "t0", "t1"]
            )

    return work


def _coordinates(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COORDINATES)


def correlations(classes: DataFrame) -> np.ndarray:
    """How often two coordinates' bits agree over all classes: a COORDINATES x COORDINATES matrix."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((COORDINATES, COORDINATES))
        for batch in batches:
            bits = ((_coordinates(batch.column(0)) & 1).astype(np.float32) * 2 - 1) if batch.num_rows else np.empty((0, COORDINATES), np.float32)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(COORDINATES)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "g"])

    added = classes.select("sk").mapInArrow(gram, "i long, g array<double>").select("i", F.posexplode("g").alias("j", "g")).groupBy("i", "j").agg(F.sum("g").alias("g"))
    out = np.zeros((COORDINATES, COORDINATES))
    for r in added.collect():  # COORDINATES squared rows
        out[r["i"], r["j"]] = r["g"]
    return np.abs(out)


def grouped_coordinates(agree: np.ndarray, width: int = WIDTH) -> list[list[int]]:
    """Partitions of ``width`` coordinates: the strongest free pair starts one, then what agrees most with it joins."""
    agree = agree.copy()
    np.fill_diagonal(agree, -1)
    free, out = set(range(len(agree))), []
    while free:
        f = sorted(free)
        sub = agree[np.ix_(f, f)]
        i = int(sub.max(1).argmax())
        part = [f[i]]
        while len(part) < width and len(part) < len(f):
            rest = [c for c in f if c not in part]
            part.append(max(rest, key=lambda c: (agree[part, c].sum(), -c)))
        out.append(sorted(part))
        free -= set(part)
    return out


def probe_keys(coordinates: np.ndarray, part: int, columns: list[int], t: int) -> np.ndarray:
    """Keys of a partition at threshold ``t``: one for each choice of len(columns) - t coordinates."""
    out = []
    for k, chosen in enumerate(combinations(columns, len(columns) - t)):
        h = np.full(len(coordinates), np.uint64(part * 1000 + t * 100 + k + 1))
        for c in chosen:
            h = mix(h * _M1 + coordinates[:, c].astype(np.uint64))
        out.append(h)
    return np.stack(out, 1)


def estimates(classes: DataFrame, parts: list[list[int]], options: list[int]) -> dict[tuple[int, int], float]:
    """Estimated pairs of classes that share a key, for every partition and threshold, from all classes.

    Second-moment sketches: every key adds a random sign to one of MOMENT_CELLS cells; the squared cells sum to the second
    moment of the key counts without bias. They add up over tasks.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x = _coordinates(batch.column(0)) if batch.num_rows else np.empty((0, COORDINATES), np.uint16)
            for p, columns in enumerate(parts):
                for t in options:
                    for k, h in enumerate(probe_keys(x, p, columns, t).T):
                        c = cells.setdefault((p, t * 100 + k), np.zeros(MOMENT_CELLS))
                        sign = 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)).astype(float)
                        c += np.bincount((h & np.uint64(MOMENT_CELLS - 1)).astype(np.int64), weights=sign, minlength=MOMENT_CELLS)
        keys = list(cells)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([cells[k].tolist() for k in keys], pa.list_(pa.float64()))], names=["p", "o", "c"])

    flat = classes.select("sk").mapInArrow(moments, "p int, o int, c array<double>").select("p", "o", F.posexplode("c").alias("i", "c"))
    added = flat.groupBy("p", "o", "i").agg(F.sum("c").alias("c")).groupBy("p", "o").agg(F.sum(F.col("c") * F.col("c")).alias("f2"))
    out: dict[tuple[int, int], float] = {}
    for r in added.collect():  # a row a partition and key
        at = (r["p"], r["o"] // 100)
        out[at] = out.get(at, 0.0) + r["f2"]
    return out


def allocate(cost: dict[tuple[int, int], float], parts: int, options: list[int], budget: int) -> list[int]:
    """Thresholds t_i of least total cost with the sum of (t_i + 1) at least ``budget``; -1 (no probe) costs nothing."""
    inf = float("inf")
    best = [0.0] + [inf] * budget
    choice: list[list[int]] = []
    for p in range(parts):
        new, pick = [inf] * (budget + 1), [-1] * (budget + 1)
        for b in range(budget + 1):
            for t in (-1, *options):
                from_ = max(0, b - (t + 1))
                c = best[from_] + (cost.get((p, t), 0.0) if t >= 0 else 0.0)
                if c < new[b]:
                    new[b], pick[b] = c, t
        best = new
        choice.append(pick)
    out, b = [], budget
    for p in range(parts - 1, -1, -1):
        t = choice[p][b]
        out.append(t)
        b = max(0, b - (t + 1))
    return out[::-1]


def miss(thresholds: list[int], overlap: float, width: int = WIDTH) -> float:
    """The chance that a pair of this overlap meets in no partition."""
    out = 1.0
    for t in thresholds:
        out *= 1 - sum(math.comb(width, d) * (1 - overlap) ** d * overlap ** (width - d) for d in range(t + 1))
    return out


def thresholds(cost: dict[tuple[int, int], float], parts: int, overlap: float, options: list[int]) -> list[int] | None:
    """The cheapest allocation whose chance to miss a pair at ``overlap`` is at most MISS, by raising the budget D + 1; None if
    these options have no such allocation."""
    for budget in range(1, parts * (max(options) + 1) + 1):
        t = allocate(cost, parts, options, budget)
        if miss(t, overlap) + test_miss(overlap) <= MISS:
            return t
    return None


def most_different_bits(overlap: float) -> int:
    """Test bits that two sets of this overlap may differ in, 4.5 standard deviations above the mean."""
    p = (1 - overlap) / 2
    return int(TEST_BITS * p + 4.5 * math.sqrt(TEST_BITS * p * (1 - p)))


def test_miss(overlap: float) -> float:
    """The chance that two sets of this overlap differ in more test bits than that."""
    p = (1 - overlap) / 2
    return sum(math.comb(TEST_BITS, d) * p**d * (1 - p) ** (TEST_BITS - d) for d in range(most_different_bits(overlap) + 1, TEST_BITS + 1))


def heavy_keys(classes: DataFrame, probes: list[tuple[int, list[int], int]], n: int, block: int) -> dict[int, int]:
    """Keys that more than about ``block`` classes share, with their number: at most HEAVY of one partition's choice.

    A key is counted where a batch holds it more than twice its share of a heavy one's rows, so the count is a lower bound
    and only keys that matter travel. Keys that are missed are joined like any other.
    """
    least = max(block, n // HEAVY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _coordinates(batch.column(0)) if batch.num_rows else np.empty((0, COORDINATES), np.uint16)
            floor = max(2, batch.num_rows * least // max(1, 2 * n))
            keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for p, columns, t in probes:
                for h in probe_keys(x, p, columns, t).T:
                    k, c = np.unique(h, return_counts=True)
                    keys.append(k[c >= floor].view(np.int64))
                    counts.append(c[c >= floor])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(counts))], names=["k", "n"])

    found = classes.select("sk").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") > least)
    return {r["k"]: r["n"] for r in found.collect()}  # HEAVY times the probes at most


def pairs(df: DataFrame, text: str, run: int = 5, overlap: float = 0.8, least_words: int = 0, key: str = "id", version: str = "scraped_at") -> tuple[DataFrame, DataFrame]:
    """(links, members): pairs of classes of texts whose overlap is at least ``overlap``, and the class of every record.

    links (a, b, overlap) with a < b; members (id, cls). The overlap is that of the sets of runs of ``run`` words, exact.
    Null and empty texts and those of fewer than ``run`` or ``least_words`` words are in no class; a key counts by its latest
    version. Columns beside those named play no part. Raises ValueError where no allocation finds pairs of so low an overlap
    with a chance of 1 - MISS.
    """
    source = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), version_of(version).alias("v"), F.col(text).alias("x"))
    all_rows = stored(source.mapInArrow(_sketched(run, least_words), "id string, v timestamp, cls binary, sk binary, t0 long, t1 long"), "sketches")
    members = all_rows.groupBy("id").agg(F.max_by(F.struct("v", "cls"), "v").alias("s")).select("id", "s.v", "s.cls").where("cls IS NOT NULL")
    members = stored(members, "members")
    holder = members.groupBy("cls").agg(F.min(F.struct("id", "v")).alias("s")).select("cls", "s.id", "s.v")
    classes = all_rows.where("cls IS NOT NULL").select("id", "v", "sk", "t0", "t1").join(holder, ["id", "v"]).select("cls", "id", "v", "sk", "t0", "t1").dropDuplicates(["cls"])
    classes = stored(classes.withColumn("c", F.monotonically_increasing_id()), "classes")  # c stands for the class in the join
    classes = spread(classes)
    n = classes.count()
    parts = grouped_coordinates(correlations(classes))
    options = [0, 1]
    chosen = thresholds(estimates(classes, parts, options), len(parts), overlap, options)
    if chosen is None:
        options = list(range(WIDTH))
        chosen = thresholds(estimates(classes, parts, options), len(parts), overlap, options)
    if chosen is None:
        raise ValueError(f"pairs of overlap {overlap} cannot be found with a chance of {1 - MISS}")
    probes = [(p, columns, t) for p, (columns, t) in enumerate(zip(parts, chosen)) if t >= 0]
    heavy = heavy_keys(classes, probes, n, BLOCK)
    heavy_names = np.array(sorted(heavy), np.int64)
    blocks = np.array([-(-heavy[k] // BLOCK) for k in heavy_names.tolist()], np.int64)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each key that is not heavy."""
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = _coordinates(batch.column(1))
            for p, columns, t in probes:
                for h in probe_keys(x, p, columns, t).T:
                    k = np.ascontiguousarray(h).view(np.int64)
                    out = pa.RecordBatch.from_arrays([pa.array(k), batch.column(0), batch.column(2), batch.column(3)], names=["k", "c", "t0", "t1"])
                    yield out.filter(pa.array(~np.isin(k, heavy_names))) if len(heavy_names) else out

    def probe_heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row (k, i, j, left) for each heavy key and each pair i <= j of its blocks that the class's block is in; on the diagonal both sides."""
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, c = _coordinates(batch.column(1)), batch.column(0).to_numpy()
            for p, columns, t in probes:
                for h in probe_keys(x, p, columns, t).T:
                    k = np.ascontiguousarray(h).view(np.int64)
                    rows = np.flatnonzero(np.isin(k, heavy_names))
                    if not len(rows):
                        continue
                    of = blocks[np.searchsorted(heavy_names, k[rows])]
                    own = (mix(c[rows].astype(np.uint64)) % of.astype(np.uint64)).astype(np.int64)
                    r = np.repeat(np.arange(len(rows)), of + 1)  # with every block once, with its own twice
                    other = np.arange(len(r)) - np.repeat(np.cumsum(of + 1) - of - 1, of + 1)
                    again = other == of[r]
                    other = np.where(again, own[r], other)
                    left = np.where(again, True, other > own[r])
                    at = pa.array(rows[r])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k[rows[r]]), pa.array(np.minimum(own[r], other)), pa.array(np.maximum(own[r], other)), pa.array(left), *[batch.column(q).take(at) for q in (0, 2, 3)]],
                        names=["k", "i", "j", "left", "c", "t0", "t1"],
                    )

    keys = classes.select("c", "sk", "t0", "t1").mapInArrow(probe, "k long, c long, t0 long, t1 long")
    limit = most_different_bits(overlap)
    l, r = keys.alias("l"), keys.alias("r")
    apart = F.bit_count(F.col("l.t0").bitwiseXOR(F.col("r.t0"))) + F.bit_count(F.col("l.t1").bitwiseXOR(F.col("r.t1")))
    met = l.join(r, (F.col("l.k") == F.col("r.k")) & (F.col("l.c") < F.col("r.c")) & (apart <= limit))
    met = met.select(F.col("l.c").alias("a"), F.col("r.c").alias("b"))
    if heavy:
        tiles = classes.select("c", "sk", "t0", "t1").mapInArrow(probe_heavy, "k long, i long, j long, left boolean, c long, t0 long, t1 long")
        l, r = tiles.where("left").alias("l"), tiles.where("NOT left").alias("r")
        same = [F.col(f"l.{x}") == F.col(f"r.{x}") for x in ("k", "i", "j")]
        across = l.join(r, [*same, (F.col("l.i") < F.col("l.j")) | (F.col("l.c") < F.col("r.c")), apart <= limit])
        met = met.union(across.select(F.least("l.c", "r.c").alias("a"), F.greatest("l.c", "r.c").alias("b")))
    candidates = stored(met.distinct(), "candidates")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, hashes, _ = word_runs(batch.column(1).to_pylist(), run, least_words)
            s = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), s], names=["c", "s"])

    wanted = classes.join(candidates.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "c", "left_semi").select("c", "id", "v")
    texts = source.join(wanted, ["id", "v"]).select("c", "x").dropDuplicates(["c"])
    held = stored(texts.mapInArrow(sets, "c long, s array<long>"), "sets")
    both = candidates.join(held.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a").join(held.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = batch.column(2), batch.column(3)
            oa, ob = sa.offsets.to_numpy(), sb.offsets.to_numpy()
            va, vb = sa.values.to_numpy(), sb.values.to_numpy()
            o = np.empty(batch.num_rows)
            for i in range(batch.num_rows):
                x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
                n = len(np.intersect1d(x, y, assume_unique=True))
                o[i] = n / (len(x) + len(y) - n)
            keep = pa.array(np.flatnonzero(o >= overlap - 1e-12))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(o).take(keep)], names=["a", "b", "overlap"])

    links = both.select("a", "b", "sa", "sb").mapInArrow(verify, "a long, b long, overlap double")
    name = lambda side: classes.select(F.col("c").alias(side), F.col("cls").alias(f"{side}_"))
    links = links.join(name("a"), "a").join(name("b"), "b").select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b"), "overlap")
    return links, members.select("id", "cls")


def record_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b): all pairs of records, id_a < id_b, of linked classes or of one class.

    As many rows as there are pairs; ``links`` and ``members`` say the same in a bounded form.
    """
    x, y = members.select(F.col("id").alias("x"), F.col("cls").alias("a")), members.select(F.col("id").alias("y"), F.col("cls").alias("b"))
    across = links.select("a", "b").join(x, "a").join(y, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    several = members.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls")
    copies = members.join(several, "cls")
    within = copies.select(F.col("id").alias("id_a"), "cls").join(copies.select(F.col("id").alias("id_b"), "cls"), "cls").where("id_a < id_b").select("id_a", "id_b")
    return across.union(within)
