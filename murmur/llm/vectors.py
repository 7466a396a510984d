"""Vectors of posts: which are usable, which rows stand for all copies, and coarse cells that bring similar ones together.

Vectors are read from the scan where they are needed and shuffled once; the version rule and the collapse of
identical vectors run over keys alone (id, version, hash of the vector).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.dense import unit
from murmur.functions.dense import unpack as unpack_list
from murmur.operators.grouped_arrow import by_group
from murmur.operators.versions import version_of
from murmur.sources.shared import stored
from murmur.sources.tables import clustered

#: Keys of rows to leave out are sent to every executor up to this number (16 bytes each); beyond it they are joined.
BROADCAST_KEYS = 1_000_000
#: Vectors used to place the cells: a bounded sample by hash of id, at most this many and this many a cell.
SAMPLE, PER_CELL = 65_536, 256
#: Cells that are fitted at once, on the driver or in a task. More cells (of over a billion vectors) are fitted in two levels.
AT_ONCE = 16_384
#: Members of a cell in one task, pairs of one tile.
BLOCK, TILE_PAIRS = 32_768, 1 << 21
#: Vectors whose partners are looked up by brute force to fit the slack, and the share of these partners that must meet.
QUERIES, MEET = 1024, 0.99


def unpack(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix): the usable vectors of an array column, or all of a column of bytes that ``packed_rows`` wrote."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_binary(column.type):
        return unpack_list(column, dim)
    x = np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)
    return np.arange(len(column)), x


def packed_rows(rows: DataFrame, dim: int) -> DataFrame:
    """(id, x): the usable vectors of ``rows`` (id, x) as bytes, written once for many passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = unpack(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "x"])

    return stored(rows.select("id", "x").mapInArrow(run, "id string, x binary"), "vectors")


def vector_hash(x: np.ndarray) -> list[bytes]:
    """A 128-bit hash of each row's bytes; negative zero equals zero."""
    import xxhash

    x = x + np.float32(0.0)
    width = x.shape[1] * 4
    data = memoryview(x.tobytes())
    return [xxhash.xxh3_128_digest(data[i : i + width]) for i in range(0, len(data), width)]


def keys(df: DataFrame, fields: dict[str, int], key: str = "id", version: str = "scraped_at", text: str | None = None, least_words: int = 30) -> DataFrame:
    """(id, version, h0, h1, ..., c): 128-bit hashes of each row's usable vectors, null where there is none.

    ``c`` is the hash of the text without white space at its ends, null for texts of fewer than ``least_words``
    words; only with ``text``.
    """
    dims = list(fields.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import xxhash

        word = regex.compile(r"[\p{L}\p{N}]+")
        for batch in batches:
            n, out = batch.num_rows, [batch.column(0), batch.column(1)]
            for i, dim in enumerate(dims):
                rows, x = unpack(batch.column(2 + i), dim)
                h: list[bytes | None] = [None] * n
                for r, digest in zip(rows.tolist(), vector_hash(x)):
                    h[r] = digest
                out.append(pa.array(h, pa.binary()))
            if text is not None:
                c: list[bytes | None] = []
                for t in batch.column(2 + len(dims)).to_pylist():
                    t = t.strip() if t else ""
                    enough = bool(t) and sum(1 for _ in zip(range(least_words), word.finditer(t.lower()))) == least_words
                    c.append(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) if enough else None)
                out.append(pa.array(c, pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=["id", "v", *[f"h{i}" for i in range(len(dims))], *["c"] * (text is not None)])

    columns = [F.col(key).alias("id"), version_of(version).alias("v"), *[F.col(f).cast("array<float>") for f in fields], *([F.col(text)] if text is not None else [])]
    schema = "id string, v timestamp, " + ", ".join(f"h{i} binary" for i in range(len(dims))) + (", c binary" if text is not None else "")
    return df.where(F.col(key).isNotNull()).select(*columns).mapInArrow(run, schema)


def row_key(field: int) -> list[Column]:
    """The 128-bit key of a stored row of one field."""
    return [F.xxhash64(F.lit(field), F.col("id"), F.col("v")).alias("k0"), F.xxhash64(F.col("v"), F.col("id"), F.lit(~field)).alias("k1")]


def without(df: DataFrame, excluded: DataFrame) -> DataFrame:
    """Rows of ``df`` whose (k0, k1) is not in ``excluded``: broadcast while small (checked), joined beyond that."""
    if excluded.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        excluded = F.broadcast(excluded)
    return df.join(excluded, ["k0", "k1"], "left_anti")


def vectors(df: DataFrame, field: str, number: int, classes: DataFrame, every: DataFrame, key: str = "id", version: str = "scraped_at") -> DataFrame:
    """(id, x): the stored vectors of the rows that stand for a class of identical vectors.

    ``every``: (id, v) of all rows with a usable vector; ``classes``: (id, v) of those that stand for a class.
    """
    keyed = lambda d: d.select(*row_key(number))
    excluded = stored(keyed(every).distinct().join(keyed(classes), ["k0", "k1"], "left_anti"), f"excluded{number}")
    rows = df.where(F.col(key).isNotNull() & F.col(field).isNotNull()).select(F.col(key).alias("id"), version_of(version).alias("v"), F.col(field).cast("array<float>").alias("x"))
    return without(rows.select("*", *row_key(number)), excluded).select("id", "x")


def raw_vectors(rows: DataFrame, wanted: DataFrame, dim: int) -> DataFrame:
    """(id, x): the usable vectors of ``rows`` (id, x) whose id is in ``wanted`` (id), as bytes, one an id."""
    keyed = wanted.select(F.xxhash64("id").alias("k"))
    if wanted.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        keyed = F.broadcast(keyed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = unpack(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "x"])

    few = rows.select("id", "x", F.xxhash64("id").alias("k")).join(keyed, "k", "left_semi").select("id", "x")
    return few.mapInArrow(run, "id string, x binary").join(wanted, "id", "left_semi").dropDuplicates(["id"])


def cells_for(n: int) -> int:
    """Half the square root of the number of vectors: work grows as n^1.5, and with fewer borders there are fewer visits."""
    return int(max(1, np.sqrt(n) / 2))


def tile_rows(members: int) -> int:
    """Rows of a tile that meets so many members at once: about TILE_PAIRS products."""
    return max(16, min(512, TILE_PAIRS // max(1, members)))


def sampled(rows: DataFrame, share: float, salt: str) -> DataFrame:
    """A share of the rows by hash of id."""
    return rows.where(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)))


def _halves(dim: int):
    """Unit vectors in half precision: enough to place centres, and half of what is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = unpack(batch.column(0), dim)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in unit(x).astype(np.float16)], pa.binary())], names=["u"])

    return run


def _fitted(x: np.ndarray, wanted: int, rounds: int) -> np.ndarray:
    """Centres of ``wanted`` cells of unit vectors, the same whatever their order."""
    x = x[np.lexsort(x.T[:3])]
    return x if len(x) <= wanted else lloyd(x, x[np.random.default_rng(7).permutation(len(x))[:wanted]].copy(), rounds)


def place_cells(rows: DataFrame, n: int, dim: int, rounds: int = 25) -> np.ndarray:
    """Unit centres of ``cells_for(n)`` cells, fitted on a bounded sample of ``rows`` (id, x) by hash of id.

    The driver's sample has about SAMPLE vectors at most (a share by hash, 10 % above it); all rows are assigned to cells afterwards. Above AT_ONCE
    cells the driver fits the square root of their number and tasks fit the rest inside (``inner_cells``).
    """
    wanted = cells_for(n)
    top = wanted if wanted <= AT_ONCE else cells_for(wanted)
    picked = sampled(rows, 1.1 * min(SAMPLE, PER_CELL * top) / max(1, n), "cells")
    received = picked.select("x").mapInArrow(_halves(dim), "u binary").toArrow().column("u")
    x = np.frombuffer(b"".join(v.as_buffer() for c in received.chunks for v in c), np.float16).reshape(-1, dim).astype(np.float32)
    del received
    if not len(x):
        return np.zeros((1, dim), np.float32)
    centres = _fitted(x, top, rounds)
    return centres if top == wanted else inner_cells(rows, centres, wanted, n, dim, rounds)


def inner_cells(rows: DataFrame, top: np.ndarray, wanted: int, n: int, dim: int, rounds: int = 25) -> np.ndarray:
    """Centres of about ``wanted`` cells inside those of ``top``: each is fitted in a task on a sample of its own vectors.

    About PER_CELL vectors for each wanted cell are drawn, at most SAMPLE for a task: larger cells are divided by hash of id. What the
    driver receives are the centres, one for every square root of the vectors.
    """
    shared = rows.sparkSession.sparkContext.broadcast(top)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = unpack(batch.column(1), dim)
            u = unit(x)
            home = nearest(u.astype(np.float32), shared.value, 1024)
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), batch.column(0).take(pa.array(at)), pa.array([v.tobytes() for v in u.astype(np.float16)], pa.binary())], names=["cell", "id", "u"])

    def fit(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch]:
        x = np.frombuffer(b"".join(t.column("u").to_pylist()), np.float16).reshape(-1, dim).astype(np.float32)
        made = _fitted(x, max(1, min(AT_ONCE, round(len(x) / PER_CELL))), rounds)
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in made.astype(np.float32)], pa.binary())], names=["c"])

    drawn = stored(sampled(rows.select("id", "x"), 1.1 * PER_CELL * wanted / max(1, n), "inner").mapInArrow(homes, "cell int, id string, u binary"), "inner")
    parts = drawn.groupBy("cell").agg(F.ceil(F.count("*") / SAMPLE).alias("parts"))
    spread = drawn.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))  # a row a cell of the top
    found = clustered(spread.select("cell", "part", "u"), "cell", "part").sortWithinPartitions("cell", "part", "u").mapInArrow(by_group(["cell", "part"], fit), "c binary")
    return np.frombuffer(b"".join(found.toArrow().column("c").to_pylist()), np.float32).reshape(-1, dim).copy()


def partners(rows: DataFrame, n: int, dim: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(u, w): unit vectors of about QUERIES rows (id, x) by hash of id, each beside one of its up to k best partners among all rows, by brute force."""
    asked = sampled(rows.select("id", "x"), QUERIES / max(1, n), "queries").toArrow()
    at, x = unpack(asked.column(1), dim)
    ids = np.array(asked.column(0).to_pylist(), dtype=object)[at]
    shared = rows.sparkSession.sparkContext.broadcast((ids, unit(x).astype(np.float32)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        held = (np.empty(0, np.int64), np.empty(0, np.float32), np.empty((0, dim), np.float32))
        for batch in batches:
            rows_, x = unpack(batch.column(1), dim)
            if not len(x) or not len(q):
                continue
            own = np.array(batch.column(0).take(pa.array(rows_)).to_pylist(), dtype=object)
            u = unit(x).astype(np.float32)
            found = [held]
            for s in range(0, len(u), 2048):
                sims = u[s : s + 2048] @ q.T
                i, j = np.nonzero(sims >= least - 1e-6)
                other = own[s + i] != names[j]
                found.append((j[other], sims[i[other], j[other]], u[s + i[other]]))
            j, sims, w = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((-sims, j))
            starts = np.flatnonzero(np.r_[True, j[order][1:] != j[order][:-1]]) if len(j) else np.empty(0, np.int64)
            kept = order[np.arange(len(j)) - np.repeat(starts, np.diff(np.r_[starts, len(j)])) < k]
            held = (j[kept], sims[kept], w[kept])
        yield pa.RecordBatch.from_arrays([pa.array(held[0].astype(np.int32)), pa.array(held[1].astype(np.float64)), pa.array([v.tobytes() for v in held[2]], pa.binary())], names=["q", "s", "w"])

    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "w"))
    best = rows.select("id", "x").mapInArrow(meet, "q int, s double, w binary").withColumn("r", place).where(F.col("r") <= k).select("q", "w").toArrow()  # k a query
    w = np.frombuffer(b"".join(best.column("w").to_pylist()), np.float32).reshape(-1, dim)
    return unit(x).astype(np.float32)[best.column("q").to_numpy().astype(np.int64)] if len(w) else np.empty((0, dim), np.float32), w


def slack_for(centres: np.ndarray, u: np.ndarray, w: np.ndarray, least_pairs: int = 200, default: float = 0.03, share: float = MEET) -> float:
    """The slack with which so large a share of pairs meets: one of a pair then visits the home of the other.

    Of too few pairs nothing can be said: then it is at least the default.
    """
    if not len(u):
        return default
    hu, hw = nearest(u, centres), nearest(w, centres)
    dot = lambda x, c: np.einsum("ij,ij->i", x, centres[c])
    need = np.minimum(dot(w, hw) - dot(w, hu), dot(u, hu) - dot(u, hw))
    found = float(np.quantile(need, share)) + 1e-4
    return found if len(u) >= least_pairs else max(found, default)


def lloyd(x: np.ndarray, centres: np.ndarray, rounds: int) -> np.ndarray:
    """Spherical k-means steps; a centre without vectors stays."""
    for _ in range(rounds):
        home = nearest(x, centres)
        order = np.argsort(home, kind="stable")
        cells, starts = np.unique(home[order], return_index=True)
        sums = np.add.reduceat(x[order], starts, axis=0) if len(x) else np.empty((0, centres.shape[1]))
        length = np.sqrt((sums**2).sum(1))
        ok = length > 0
        centres[cells[ok]] = sums[ok] / length[ok][:, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """The index of the centre with the largest inner product."""
    return np.concatenate([(x[i : i + chunk] @ centres.T).argmax(1) for i in range(0, len(x), chunk)]) if len(x) else np.empty(0, np.int64)


def to_cells(rows: DataFrame, centres: np.ndarray, dim: int, slack: float, block: int, codes: bool = False) -> DataFrame:
    """(cell, part, role, id, x): every vector in its nearest cell (role 0) and as a visitor (role 1) in all cells
    whose centre's cosine is within ``slack`` of the nearest.

    Cells of more than ``block`` members, by an exact count, are split into parts by hash of id; a member is at home
    in one part and visits the others, so that no task holds a whole cell. ``x`` is the vector's bytes; with ``codes``,
    a visitor's are its int8 code, scale and error (``packed``), a quarter of the size.
    """
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            _, x = unpack(batch.column(0), dim)
            total += np.bincount(nearest(unit(x).astype(np.float32), shared.value, 1024), minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], names=["cell", "n"])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            at, x = unpack(batch.column(1), dim)
            ids = batch.column(0)
            for i in range(0, len(at), 1024):
                raw = x[i : i + 1024]
                u = unit(raw)
                s = u.astype(np.float32) @ c.T
                home = s.argmax(1)
                r, cell = np.nonzero(s >= s[np.arange(len(s)), home][:, None] - np.float32(slack))
                data = [v.tobytes() for v in raw]
                small = packed(u) if codes else data
                away = cell != home[r]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(away.astype(np.int8)), ids.take(pa.array(at[i : i + 1024][r])), pa.array([(small if y else data)[j] for j, y in zip(r, away)], pa.binary())],
                    names=["cell", "role", "id", "x"],
                )

    placed = rows.select("id", "x").mapInArrow(assign, "cell int, role byte, id string, x binary")
    counts = rows.select("x").mapInArrow(members, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    split = [(r["cell"], -(-r["n"] // block)) for r in counts.where(F.col("n") > block).collect()]  # a row a crowded cell
    if not split:
        return placed.select("cell", F.lit(0).alias("part"), "role", "id", "x")
    parts = rows.sparkSession.createDataFrame(split, "cell int, parts int")
    spread = placed.join(F.broadcast(parts), "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    spread = spread.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    role = F.when((F.col("role") == 0) & (F.col("part") == F.col("own")), F.lit(0)).otherwise(F.lit(1)).cast("byte")
    return spread.select("cell", "part", role.alias("role"), "id", "x")


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, scale, error): int8 values of unit rows, held as float32 so that BLAS multiplies them exactly (sums stay
    below 2^24), the scale of each row and the length of what rounding took away."""
    scale = np.maximum(np.abs(u).max(1), 1e-30) / 127.0
    q = np.rint(u / scale[:, None])
    error = np.sqrt(((u - q * scale[:, None]) ** 2).sum(1))
    return q.astype(np.int8).astype(np.float32), scale, error


def packed(u: np.ndarray) -> list[bytes]:
    """Unit rows as bytes: int8 code, scale and error (rounded up), both float32."""
    q, scale, error = quantised(u)
    scale, error = scale.astype(np.float32), (error * (1 + 1e-6) + 1e-7).astype(np.float32)
    return [a.tobytes() + s.tobytes() + e.tobytes() for a, s, e in zip(q.astype(np.int8), scale, error)]


def quantised_rows(rows: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``quantised`` of rows that are packed codes or vectors."""
    q, scale, error = np.empty((len(rows), dim), np.float32), np.empty(len(rows)), np.empty(len(rows))
    coded = np.array([len(r) == dim + 8 for r in rows])
    if coded.any():
        raw = np.frombuffer(b"".join(r for r, c in zip(rows, coded) if c), np.uint8).reshape(-1, dim + 8)
        q[coded] = raw[:, :dim].view(np.int8)
        ends = np.ascontiguousarray(raw[:, dim:]).view(np.float32)
        scale[coded], error[coded] = ends[:, 0], ends[:, 1]
    if not coded.all():
        plain = quantised(unit(np.frombuffer(b"".join(r for r, c in zip(rows, coded) if not c), np.float32).reshape(-1, dim)))
        q[~coded], scale[~coded], error[~coded] = plain
    return q, scale, error


def tile(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds on the cosines of two quantised blocks: (upper, margin) with upper - 2 margin a lower bound.

    |u.w - u'.w'| <= e_u + (1 + e_u) e_w for unit u, w and their quantised u', w'.
    """
    (qa, sa, ea), (qb, sb, eb) = a, b
    upper = qa @ qb.T
    upper *= (sa[:, None] * sb[None, :]).astype(np.float32)
    margin = (ea[:, None] + (1 + ea[:, None]) * eb[None, :] + 1e-6).astype(np.float32)
    upper += margin
    return upper, margin


def cosines(u: np.ndarray, w: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of pairs of unit rows in double precision, rounded to 6 decimals."""
    out = np.empty(len(i))
    for k in range(0, len(i), 65_536):
        out[k : k + 65_536] = np.einsum("ij,ij->i", u[i[k : k + 65_536]], w[j[k : k + 65_536]])
    return np.round(out, 6)


def parse(batch: pa.RecordBatch | pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors) of rows (id, x bytes)."""
    ids = np.array(batch.column("id").to_pylist(), dtype=object)
    raw = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, dim)
    return ids, unit(raw)
