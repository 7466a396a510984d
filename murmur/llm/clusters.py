"""Clusters of mutually similar records.

Records without a vector may take that of a record of the same text; texts alone become vectors of hashed weighted
features (``features.text_vectors``). k-means runs over all vectors: parallel oversampled seeding (every round keeps each vector with a
chance in proportion to its squared distance), the candidates weighted by the vectors nearest to them and
reduced on the driver, then Lloyd steps whose sums are added per cell before they are gathered. Each k-means cell, with
the vectors near its border as visitors, is searched for similar pairs in tiles; of these only a spanning star a
local group leaves the task. Stars are joined into components, and within a component the groups in which every two
are similar are taken, the largest first. Members nearest to a group's centre are its most typical.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm import vectors as V
from murmur.operators.components import components
from murmur.operators.grouped_arrow import by_group, runs
from murmur.sources.shared import stored
from murmur.sources.tables import clustered

#: Partners of a sampled vector that must meet.
PARTNERS = 10
#: Rounds of oversampling and of Lloyd over all vectors.
SEED_ROUNDS, LLOYD_ROUNDS = 2, 4


def _unit_draw(ids: list[str], salt: int) -> np.ndarray:
    """A number in [0, 1) for each id, the same on every run."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(i, seed=salt) for i in ids], np.uint64).astype(np.float64) / 2.0**64


def seed_centres(rows: DataFrame, n: int, dim: int, k: int, rounds: int = SEED_ROUNDS) -> np.ndarray:
    """``k`` unit centres from parallel oversampled seeding over all of (id, x).

    Each round draws about 2k/rounds candidates by hash of id with a chance in proportion to the squared distance
    to the candidates so far; the driver holds candidates and their weights only.
    """
    sc = rows.sparkSession.sparkContext
    rows = rows.select("id", "x")
    per_round = max(1, 2 * k // rounds)

    def distances(c: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        home, d = np.empty(len(x), np.int64), np.empty(len(x))
        for i in range(0, len(x), 1024):
            s = x[i : i + 1024] @ c.T
            home[i : i + 1024] = s.argmax(1)
            d[i : i + 1024] = np.maximum(0, 2 - 2 * s.max(1))
        return home, d

    def cost(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, weight = 0.0, np.zeros(len(shared.value), np.int64)
            for batch in batches:
                _, x = V.unpack(batch.column(1), dim)
                home, d = distances(shared.value, V.unit(x).astype(np.float32))
                total += float(d.sum())
                weight += np.bincount(home, minlength=len(weight))
            at = np.flatnonzero(weight)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[total, weight[at]].astype(float))], names=["c", "w"])

        return run

    def draw(shared, factor: float, salt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, x = V.unpack(batch.column(1), dim)
                ids = batch.column(0).take(pa.array(at)).to_pylist()
                _, d = distances(shared.value, V.unit(x).astype(np.float32)) if len(x) else (None, np.empty(0))
                hit = np.flatnonzero(_unit_draw(ids, salt) < d * factor)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in hit], pa.string()), pa.array([x[i].tobytes() for i in hit], pa.binary())], names=["id", "x"])

        return run

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's usable vector with the smallest draw."""
        best: tuple[float, str, bytes] | None = None
        for batch in batches:
            at, x = V.unpack(batch.column(1), dim)
            ids = batch.column(0).take(pa.array(at)).to_pylist()
            u = _unit_draw(ids, 99)
            if len(x):
                i = int(u.argmin())
                best = min(filter(None, (best, (float(u[i]), ids[i], x[i].tobytes()))))
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]]), pa.array([best[2]], pa.binary())], names=["u", "id", "x"])

    first = rows.mapInArrow(smallest, "u double, id string, x binary").orderBy("u", "id").limit(1).toArrow()
    if first.num_rows == 0:
        return np.zeros((1, dim), np.float32)
    centres = V.parse(first, dim)[1].astype(np.float32)
    spread = 2.0  # before the first pass: mean squared distance of unrelated unit vectors
    for r in range(rounds):
        shared = sc.broadcast(centres)
        drawn = rows.mapInArrow(draw(shared, per_round / max(1e-9, spread * n), r), "id string, x binary").dropDuplicates(["id"]).orderBy("id").toArrow()
        if drawn.num_rows:
            _, u = V.parse(drawn, dim)
            centres = np.concatenate([centres, u.astype(np.float32)])
        shared = sc.broadcast(centres)
        told = rows.mapInArrow(cost(shared), "c int, w double").groupBy("c").agg(F.sum("w").alias("w")).collect()  # a row a candidate
        weight = np.zeros(len(centres))
        for row in told:
            if row["c"] < 0:
                spread = row["w"] / max(1, n)
            else:
                weight[row["c"]] = row["w"]
    return _reduce(centres, weight, k)


def _reduce(c: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Weighted k-means++ over the candidates."""
    if len(c) <= k:
        return c
    rng = np.random.default_rng(5)
    best = np.full(len(c), 2.0)
    chosen = [int(weight.argmax())]
    for _ in range(k - 1):
        best = np.minimum(best, np.maximum(0, 2 - 2 * (c @ c[chosen[-1]])))
        p = best * weight
        if p.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(c), p=p / p.sum())))
    return c[chosen]


def lloyd_step(rows: DataFrame, centres: np.ndarray, dim: int) -> np.ndarray:
    """One k-means step over all vectors: sums per cell are added within a task, then within a cell."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(shared.value), dim))
        seen = np.zeros(len(shared.value), bool)
        for batch in batches:
            _, x = V.unpack(batch.column(0), dim)
            u = V.unit(x).astype(np.float32)
            home = V.nearest(u, shared.value, 1024)
            order = np.argsort(home, kind="stable")
            cells, starts = np.unique(home[order], return_index=True)
            if len(cells):
                total[cells] += np.add.reduceat(u[order], starts, axis=0)
                seen[cells] = True
        cells = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array([v.tobytes() for v in total[cells]], pa.binary())], names=["cell", "s"])

    def add(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch]:
        s = np.frombuffer(b"".join(t.column("s").to_pylist())).reshape(-1, dim).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([s.tobytes()], pa.binary())], names=["cell", "s"])

    schema = "cell int, s binary"
    added = rows.select("x").mapInArrow(sums, schema).repartition("cell").sortWithinPartitions("cell").mapInArrow(by_group(["cell"], add), schema)
    new = centres.astype(np.float64).copy()
    for row in added.toArrow().to_pylist():  # one centre a row
        s = np.frombuffer(row["s"])
        if s @ s > 0:
            new[row["cell"]] = s / np.sqrt(s @ s)
    return new.astype(np.float32)


def _settle(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest node reachable from each of ``n`` nodes over edges (i, j)."""
    label = np.arange(n) if label is None else label
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _stars(dim: int, least: float):
    """Rows (id, root, x): members and visitors of a cell's part that are linked there, to their local group's root.

    Members carry their vector, once; visitors carry none and come with int8 codes.
    """

    def star(ids: np.ndarray, u: np.ndarray, raw: np.ndarray, i: np.ndarray, j: np.ndarray, visitors: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        names = np.concatenate([v[0] for v in visitors]) if visitors else np.empty(0, object)
        a = np.concatenate([v[1] for v in visitors]) if visitors else np.empty(0, np.int64)
        label = _settle(len(ids), i, j)
        # a visitor with several partners joins their groups: it links each of them to itself
        linked = np.zeros(len(ids), bool)
        linked[i] = linked[j] = linked[a] = True
        at = np.flatnonzero(linked)
        out_id = [*ids[at], *names]
        out_root = [*ids[label[at]], *ids[label[a]]]
        out_x = [*(raw[k].tobytes() for k in at), *[None] * len(names)]
        if out_id:
            yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.string()), pa.array(out_root, pa.string()), pa.array(out_x, pa.binary())], names=["id", "root", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, block, visitors = None, [], None, []

        def settle() -> None:
            nonlocal block, parts
            t = pa.Table.from_batches(parts)
            ids = np.array(t.column("id").to_pylist(), dtype=object)
            raw = np.frombuffer(b"".join(t.column("x").to_pylist()), np.float32).reshape(-1, dim)
            order = np.argsort(ids)
            order = order[np.r_[True, ids[order][1:] != ids[order][:-1]]]  # rows stored twice
            ids, raw = ids[order], raw[order]
            u = V.unit(raw)
            q = V.quantised(u)
            label = np.arange(len(ids))
            tile = V.tile_rows(len(ids))
            for s in range(0, len(ids), tile):
                r, c = _pairs(u[s : s + tile], tuple(x[s : s + tile] for x in q), u, q, least)
                r = r + s
                keep = r < c
                label = _settle(len(ids), r[keep], c[keep], label)
            # the labels stand for all edges seen: a star has the same components
            inner = np.flatnonzero(label != np.arange(len(ids)))
            block, parts = (ids, u, raw, q, inner, label[inner]), []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal block, visitors
            if parts:
                settle()
            if block is not None:
                ids, u, raw, _, i, j = block
                yield from star(ids, u, raw, i, j, visitors)
            block, visitors = None, []

        for batch in batches:
            for (cell, part, role), a, b in runs(batch, ["cell", "part", "role"]):
                if (cell, part) != at:
                    yield from close()
                    at = (cell, part)
                if role == 0:
                    parts.append(batch.slice(a, b - a))
                    continue
                if parts:
                    settle()
                if block is None:
                    continue
                names = np.array(batch.column("id").slice(a, b - a).to_pylist(), dtype=object)
                codes = V.quantised_rows(batch.column("x").slice(a, b - a).to_pylist(), dim)
                tile = V.tile_rows(len(block[0]))
                for s in range(0, len(names), tile):
                    # a visitor is linked where its bound allows similarity; the groups are settled on the vectors later
                    upper, _ = V.tile(tuple(x[s : s + tile] for x in codes), block[3])
                    r, c = np.nonzero(upper >= least - 1e-6)
                    # one link to each local group suffices
                    label = np.arange(len(block[0]))
                    label[block[4]] = block[5]
                    pair = np.unique(np.stack([r, label[c]], 1), axis=0) if len(r) else np.empty((0, 2), np.int64)
                    visitors.append((names[s : s + tile][pair[:, 0]], pair[:, 1]))
        yield from close()

    return run


def _pairs(u: np.ndarray, qu: tuple, w: np.ndarray, qw: tuple, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with a rounded cosine of at least ``least``."""
    upper, _ = V.tile(qu, qw)
    i, j = np.nonzero(upper >= least - 1e-6)
    near = V.cosines(u, w, i, j) >= least
    return i[near], j[near]


def maximal_groups(adjacent: list[int]) -> list[list[int]]:
    """All maximal groups of a graph given as bit sets of neighbours (Bron and Kerbosch with pivots)."""
    found: list[list[int]] = []

    def bits(x: int) -> Iterator[int]:
        while x:
            low = x & -x
            yield low.bit_length() - 1
            x ^= low

    stack = [(0, (1 << len(adjacent)) - 1, 0)]
    while stack:
        r, p, x = stack.pop()
        if not p:
            if not x:
                found.append(list(bits(r)))
            continue
        pivot = max(bits(p | x), key=lambda v: (adjacent[v] & p).bit_count())
        for v in bits(p & ~adjacent[pivot]):
            stack.append((r | 1 << v, p & adjacent[v], x & adjacent[v]))
            p &= ~(1 << v)
            x |= 1 << v
    return found


def greedy_groups(a: np.ndarray, weight: np.ndarray) -> list[list[int]]:
    """Groups of a graph without the order of ``largest_groups``, which takes its place in queries: again and again the row with most open neighbours starts one, and rows similar to all
    of it join in order of their open neighbours."""
    open_, out = np.ones(len(a), bool), []
    while open_.any():
        degree = np.where(open_, (a & open_[None, :]) @ weight, -1)
        group, allowed = [int(degree.argmax())], a[degree.argmax()] & open_
        while allowed.any():
            inner = np.where(allowed, (a & allowed[None, :]) @ weight, -1)
            v = int(inner.argmax())
            group.append(v)
            allowed = allowed & a[v]
        out.append(sorted(group))
        open_[group] = False
    return out


def largest_groups(adjacent: list[int], weight: list[int], size: int) -> Iterator[list[int]]:
    """What the maximal groups keep, the heaviest first and of equal ones the one with the smallest members.

    A group takes what earlier ones left, if that still weighs ``size``. The next group is the heaviest of those whose rest
    is enough, found by branch and bound with weighted colourings, so groups are not listed. Exact for graphs of any size; the
    time is exponential at worst. ``bound``: the most that a group with this node can weigh; it only falls.
    """
    fresh = list(weight)
    nodes = range(len(adjacent))

    def bits(p: int) -> Iterator[int]:
        while p:
            low = p & -p
            yield low.bit_length() - 1
            p ^= low

    bound = [weight[v] + sum(weight[u] for u in bits(adjacent[v])) for v in nodes]

    def coloured(p: int) -> list[tuple[int, int]]:
        """(node, most weight of a group of the nodes up to this one): a group has one node of a colour; weights are split
        over colours."""
        rest, out, w = {v: weight[v] for v in bits(p)}, [], 0
        while p:
            q, colour = p, []
            while q:
                low = q & -q
                colour.append(low.bit_length() - 1)
                q &= ~(adjacent[colour[-1]] | low)
            step = min(rest[v] for v in colour)
            w += step
            for v in colour:
                rest[v] -= step
                if not rest[v]:
                    p ^= 1 << v
                    out.append((v, w))
        return out

    def open_weight(p: int) -> int:
        """The most fresh weight of a group in ``p``."""
        out, p = 0, sum(1 << v for v in bits(p) if fresh[v])
        while p:
            q, most = p, 0
            while q:
                low = q & -q
                v = low.bit_length() - 1
                q, p, most = q & ~(adjacent[v] | low), p ^ low, max(most, fresh[v])
            out += most
        return out

    def entered(p: int, w: int, f: int) -> tuple[int, int, int, list[int]]:
        """Nodes similar to all others of ``p`` are in every group."""
        taken = [v for v in bits(p) if p & ~adjacent[v] == 1 << v]
        for v in taken:
            p, w, f = p ^ 1 << v, w + weight[v], f + fresh[v]
        return p, w, f, taken

    def heaviest(start: int, best: int) -> int:
        """The most weight of a group with ``start``, ``best`` if none weighs more."""
        stack: list[list] = []

        def enter(p: int, w: int, f: int) -> None:
            nonlocal best
            p, w, f, _ = entered(p, w, f)
            if not p:
                best = max(best, w) if f >= size else best
            elif f >= size or f + open_weight(p) >= size:
                stack.append([p, w, f, coloured(p)])

        enter(sum(1 << u for u in bits(adjacent[start]) if bound[u] > best), weight[start], fresh[start])
        while stack:
            p, w, f, order = stack[-1]
            v, most = order.pop() if order else (-1, 0)
            if v < 0 or w + most <= best:
                stack.pop()
                continue
            stack[-1][0] = p & ~(1 << v)
            enter(p & adjacent[v], w + weight[v], f + fresh[v])
        return best

    def smallest(best: int) -> list[int]:
        """Of the groups that weigh ``best``, that with the smallest members."""
        p0 = sum(1 << v for v in nodes if bound[v] >= best)
        for s in bits(p0):
            p0 ^= 1 << s
            stack = [(p0 & adjacent[s], weight[s], fresh[s], [s])]
            while stack:
                p, w, f, group = stack.pop()
                p, w, f, taken = entered(p, w, f)
                group = group + taken
                if not p:
                    if w == best and f >= size:
                        return sorted(group)
                    continue
                if f < size and f + open_weight(p) < size or w + coloured(p)[-1][1] < best:
                    continue
                v = (p & -p).bit_length() - 1
                stack.append((p ^ 1 << v, w, f, group))
                stack.append((p & adjacent[v], w + weight[v], f + fresh[v], [*group, v]))
            bound[s] = best - 1
        raise AssertionError("no group of the weight found")

    while True:
        best = 0
        for v in sorted((v for v in nodes if fresh[v]), key=lambda v: -bound[v]):
            if bound[v] <= max(best, size - 1):
                break
            found = heaviest(v, best)
            best = bound[v] = found
        if not best:
            return
        left = [v for v in smallest(best) if fresh[v]]
        yield left
        for v in left:
            fresh[v] = 0


def _alike(u: np.ndarray, w: np.ndarray, least: float) -> np.ndarray:
    return np.round(u @ w.T, 6) >= least


def _merged(u: np.ndarray, least: float) -> np.ndarray:
    """For each row the first row that is similar to the same rows; such rows share all their groups.

    Rows are told apart by sums of random numbers over the rows similar to them, 192 bits, so no square table is held.
    """
    draws = np.random.default_rng(11).integers(0, 1 << 32, (len(u), 6)).astype(np.float64)  # sums are exact below 2^53
    sums = np.empty((len(u), 6))
    for i in range(0, len(u), 1024):
        sums[i : i + 1024] = _alike(u[i : i + 1024], u, least).astype(np.float64) @ draws
    _, first, inverse = np.unique(sums, axis=0, return_index=True, return_inverse=True)
    return first[inverse.ravel()]


def _grouped(dim: int, least: float, size: int):
    """(id, cluster, near) of a component's groups; ``near`` is the cosine to the group's centre."""

    def work(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, u = V.parse(t, dim)
        n = np.array(t.column("n").to_pylist(), np.int64)
        order = np.argsort(ids)
        order = order[np.r_[True, ids[order][1:] != ids[order][:-1]]]
        ids, u, n = ids[order], u[order], n[order]
        if n.sum() < size:
            return
        first = _merged(u, least)
        stand, of = np.unique(first, return_inverse=True)
        of = of.ravel()
        a = np.zeros((len(stand), len(stand)), bool)
        for i in range(0, len(stand), 1024):
            a[i : i + 1024] = _alike(u[stand[i : i + 1024]], u[stand], least)
        a |= a.T
        np.fill_diagonal(a, False)
        adjacent = [int.from_bytes(np.packbits(r, bitorder="little").tobytes(), "little") for r in a]
        weight = np.zeros(len(stand), np.int64)
        np.add.at(weight, of, n)
        members = np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of))[:-1])
        out: tuple[list, list, list] = ([], [], [])
        for g in largest_groups(adjacent, weight.tolist(), size):
            left = np.sort(np.concatenate([members[v] for v in g]))
            centre = (u[left] * n[left][:, None]).sum(0)
            near = u[left] @ centre / max(1e-12, np.sqrt(centre @ centre))
            out[0].extend(ids[left])
            out[1].extend([ids[left[0]]] * len(left))
            out[2].extend(np.round(near, 6).tolist())
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names=["id", "cluster", "near"])

    return by_group(["grp"], work)


def clusters(df: DataFrame, field: str, dim: int, text: str | None = None, least: float = 0.75, size: int = 3, least_words: int = 30, key: str = "id", version: str = "scraped_at") -> DataFrame:
    """(id, cluster_id, near): records in groups of at least ``size`` of which every two have cosine ``least`` or more.

    A group is one that no further record can join; of groups that overlap the larger one holds and the others keep what
    is left, if that is still ``size``. ``cluster_id`` is the smallest id, ``near`` the cosine to the group's centre.
    With ``text``, a record without a usable vector takes that of the smallest id with the same text (of at least
    ``least_words`` words, white space at its ends removed). A key counts by its latest version. Records in no group do
    not come out. A component is grouped in one task.
    """
    known = stored(V.keys(df, {field: dim}, key, version, text, least_words), "keys")
    if text is None:
        known = known.withColumn("c", F.lit(None).cast("binary"))
    live = stored(known.groupBy("id").agg(F.max_by(F.struct("v", "h0", "c"), "v").alias("s")).select("id", "s.*"), "live")
    own = live.where("h0 IS NOT NULL")
    donors = own.where("c IS NOT NULL").groupBy("c").agg(F.min(F.struct("id", "h0")).alias("d")).select("c", F.col("d.h0").alias("h"))
    takers = live.where("h0 IS NULL AND c IS NOT NULL").select("id", "c").join(donors, "c").select("id", "h")
    classes = own.groupBy(F.col("h0").alias("h")).agg(F.min(F.struct("id", "v")).alias("s")).select("h", "s.id", "s.v")
    holders = own.select("id", F.col("h0").alias("h")).union(takers)
    sizes = holders.groupBy("h").agg(F.count("*").alias("n"))
    classes = stored(classes.join(sizes, "h"), "classes")
    n = classes.count()
    empty = df.sparkSession.createDataFrame([], "id string, cluster_id string, near double")
    if n == 0:
        return empty
    rows = V.packed_rows(V.vectors(df, field, 0, classes, known.where("h0 IS NOT NULL").select("id", "v"), key, version), dim)
    k = V.cells_for(n)
    top = k if k <= V.AT_ONCE else V.cells_for(k)
    centres = seed_centres(rows, n, dim, top)
    if top < k:
        centres = V.inner_cells(rows, centres, k, n, dim)
    for _ in range(LLOYD_ROUNDS):
        centres = lloyd_step(rows, centres, dim)
    slack = V.slack_for(centres, *V.partners(rows, n, dim, PARTNERS, least))
    cells = V.to_cells(rows, centres, dim, slack, V.BLOCK, codes=True)
    stars = stored(clustered(cells, "cell", "part", size=2 * n * (4 * dim + 40)).sortWithinPartitions("cell", "part", "role").mapInArrow(_stars(dim, least), "id string, root string, x binary"), "stars")
    joined = components(stars, "id", "root")
    held = stars.where("x IS NOT NULL").select("id", "x").dropDuplicates(["id"])
    # linked only where they visit: their partners do not visit their home cell
    away = stored(stars.groupBy("id").agg(F.count("x").alias("homes")).where("homes = 0").select("id"), "away")
    held = held.union(V.raw_vectors(rows, away, dim))
    members = held.join(joined.select(F.col("node").alias("id"), F.col("component").alias("grp")), "id")
    members = members.join(classes.select("id", "n"), "id")
    found = stored(clustered(members, "grp").sortWithinPartitions("grp").mapInArrow(_grouped(dim, least, size), "id string, cluster string, near double"), "groups")
    copies = classes.where(F.col("n") >= size).select("id").join(found.select("id"), "id", "left_anti")
    found = found.union(copies.select("id", F.col("id").alias("cluster"), F.lit(1.0).alias("near")))
    found = stored(found.join(classes.select("id", "h"), "id").select("h", "cluster", "near").join(holders, "h").select("id", "cluster", "near"), "clusters")
    names = found.groupBy("cluster").agg(F.min("id").alias("cluster_id"))
    return found.join(names, "cluster").select("id", "cluster_id", "near")


def describe(found: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster_id, size, typical): each cluster's size and its members nearest to the centre, the smaller id first when equal."""
    sizes = found.groupBy("cluster_id").agg(F.count("*").alias("size"))
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("near"), "id"))
    top = found.withColumn("r", place).where(F.col("r") <= typical).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("r", "id"))).alias("t"))
    return sizes.join(top, "cluster_id").select("cluster_id", "size", F.transform("t", lambda x: x["id"]).alias("typical"))
