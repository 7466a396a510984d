"""Nearest rows to one query vector, rank fusion, and groups among a bounded set of candidates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.dense import unit, unpack
from murmur.functions.scalars import first_sentence
from murmur.operators.grouped_arrow import by_group
from murmur.sources import settings as S
from murmur.sources.tables import clustered


def scored(df: DataFrame, key: str, field: str, vector: Sequence[float], more: Sequence[str] = ()) -> DataFrame:
    """(key, more..., score): V2, V5: the cosine of every vector with the query vector, to 6 decimals.

    Vectors of another length than the query's or without a direction have a null score, as has every row of a zero query. Only what
    is named is read, and the vectors go no further than this.
    """
    q = np.asarray(vector, float)
    size = float(np.sqrt(q @ q))
    q = q / size if size else q
    rows = df.select(F.col(key).alias("k"), *[F.col(c).alias(f"m{i}") for i, c in enumerate(more)], F.col(field).cast("array<float>").alias("x"))
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = unpack(batch.column(len(names)), len(q)) if size else (np.empty(0, np.int64), np.empty((0, len(q))))
            score, there = np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            if len(x):
                score[at], there[at] = np.round(unit(x) @ q, 6), True
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], pa.array(score, mask=~there)], names=[*names, "score"])

    types = dict(rows.dtypes)
    out = rows.mapInArrow(run, ", ".join(f"{n} {types[n]}" for n in names) + ", score double")
    return out.select(F.col("k").alias(key), *[F.col(f"m{i}").alias(c) for i, c in enumerate(more)], "score")


def nearest(df: DataFrame, key: str, field: str, vector: Sequence[float], k: int = S.RETRIEVED) -> DataFrame:
    """(key, score): O5: the ``k`` rows most similar to the query vector, the smaller key first when equal; rows without a score are none."""
    return best_scored(scored(df, key, field, vector), key, k)


def best_scored(rows: DataFrame, key: str, k: int = S.RETRIEVED) -> DataFrame:
    return rows.where("score IS NOT NULL").select(key, "score").orderBy(F.desc("score"), key).limit(k)


def fused(lists: Sequence[DataFrame], key: str, k: int = S.RRF_K) -> DataFrame:
    """(key, score, place): V7, W8: reciprocal rank fusion of lists (key, rank from 1), the best first.

    A key counts once a list, by its best rank; ties go to the earlier list, then to the better rank in it.
    """
    tagged = [x.groupBy(key).agg(F.min("rank").alias("rank")).withColumn("list", F.lit(i)) for i, x in enumerate(lists)]
    rows = tagged[0]
    for x in tagged[1:]:
        rows = rows.unionByName(x)
    sums = rows.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    place = F.row_number().over(Window.orderBy(F.desc("score"), "first.list", "first.rank", key))  # retrieved rows only
    return sums.withColumn("place", place.cast("long")).select(key, "score", "place")


def combined(text: np.ndarray, image: np.ndarray | None, has: np.ndarray | None) -> np.ndarray:
    """V3: pairwise similarity: text, and a quarter image where both have one."""
    s = text @ text.T
    if image is not None and has is not None:
        both = has[:, None] & has[None, :]
        s = np.where(both, S.TEXT_WEIGHT * s + S.IMAGE_WEIGHT * (image @ image.T), s)
    return s


def linked_groups(s: np.ndarray, least: float) -> list[list[int]]:
    """V9: connected components of pairs of at least ``least``, of two or more, in order of their first member."""
    n = len(s)
    label = np.arange(n)
    i, j = np.nonzero(np.triu(s >= least, 1))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [g.tolist() for r in np.unique(label) if len(g := np.flatnonzero(label == r)) >= S.GROUP_LEAST]


def greedy_clusters(s: np.ndarray, least: float, floor: float = S.CONTENT_FLOOR) -> list[list[int]]:
    """Clusters grown over pairs from the most similar down; a row joins where its mean to the members is at least ``least`` and
    none is under ``floor``; clusters never merge."""
    i, j = np.nonzero(np.triu(s >= least, 1))
    order = np.lexsort((j, i, -s[i, j]))
    of: dict[int, int] = {}
    clusters: list[list[int]] = []

    def joins(v: int, members: list[int]) -> bool:
        to = s[v, members]
        return bool(to.mean() >= least and to.min() >= floor)

    for a, b in zip(i[order].tolist(), j[order].tolist()):
        if a not in of and b not in of:
            of[a] = of[b] = len(clusters)
            clusters.append([a, b])
        elif (a in of) != (b in of):
            inside, new = (a, b) if a in of else (b, a)
            if joins(new, clusters[of[inside]]):
                of[new] = of[inside]
                clusters[of[inside]].append(new)
    return clusters


def star_groups(s: np.ndarray, least: float) -> list[list[int]]:
    """Each row not yet in a group takes all later free rows of at least ``least``; groups of two or more."""
    free, out = np.ones(len(s), bool), []
    for v in range(len(s)):
        if free[v]:
            near = [v, *[w for w in range(v + 1, len(s)) if free[w] and s[v, w] >= least]]
            if len(near) >= S.GROUP_LEAST:
                free[near] = False
                out.append(near)
    return out


GROUPED = "group_no long, size long, ids string, similarity double, total_likes long, total_shares long, top_id string"


def candidate_groups(candidates: DataFrame, dims: tuple[int, int], kind: str, least: float) -> DataFrame:
    """Groups among a bounded set of candidates (at most CANDIDATES rows: id, likes, shares, text, image vectors), in one task.

    ``kind``: image (linked by image vectors), content (greedy, text and image), star and image_star (text and image vectors). Rows
    count in order of likes, then id. Result: number by total likes and shares, size, the ids in order, mean pairwise similarity,
    totals, the member that stands for the group: the one with most likes and shares (content: the most central, stars: the
    one with most likes, which started it).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        frame = t.select(["id", "likes", "shares"]).to_pandas()
        order = frame.sort_values(["likes", "id"], ascending=[False, True]).index.to_numpy()
        order = order[: S.CANDIDATES]
        ids, likes, shares = (frame[c].to_numpy()[order] for c in ("id", "likes", "shares"))
        full: list[tuple[np.ndarray, np.ndarray]] = []
        for name, dim in zip(("text", "image"), dims):
            at, x = unpack(t.column(name), dim)
            m, has = np.zeros((len(frame), dim)), np.zeros(len(frame), bool)
            m[at], has[at] = unit(x) if len(x) else x, True
            full.append((m[order], has[order]))
        (text, has_text), (image, has_image) = full
        if kind in ("image", "image_star"):
            rows = np.flatnonzero(has_image)
            s = image[rows] @ image[rows].T
        else:
            rows = np.flatnonzero(has_text)
            s = combined(text[rows], image[rows], has_image[rows]) if kind == "content" else text[rows] @ text[rows].T
        s = np.round(s, 6)
        groups = {"image": linked_groups, "content": greedy_clusters}.get(kind, star_groups)(s, least)
        out = []
        for g in groups:
            sub = s[np.ix_(g, g)]
            mean = float(sub[np.triu_indices(len(g), 1)].mean())
            members = rows[g]
            engaged = likes[members] + shares[members]
            top = {"image": int(engaged.argmax()), "content": int(((sub.sum(1) - 1) / (len(g) - 1)).round(6).argmax())}.get(kind, 0)
            out.append((len(g), "|".join(sorted(ids[members])), round(mean, 6), int(likes[members].sum()), int(shares[members].sum()), ids[members][top]))
        out.sort(key=lambda r: (-(r[3] + r[4]), r[1]))
        columns = list(zip(*[(i + 1, *r) for i, r in enumerate(out)])) or [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in GROUPED.split(", ")])

    return candidates.select("id", "likes", "shares", "text", "image").coalesce(1).mapInArrow(run, GROUPED)


def labelled(groups: DataFrame, texts: DataFrame, kind: str) -> DataFrame:
    """``groups`` with ``label``, from (id, content, image_description) of the members that stand for them.

    V9: the image's description or else the first 100 characters of the trimmed text; V10: its first sentence.
    """
    shown = F.coalesce("image_description", F.when(F.col("content") != "", F.substring(F.trim("content"), 1, 100)))
    label = first_sentence(F.col("content")) if kind == "content" else shown
    return groups.join(texts.select(F.col("id").alias("top_id"), label.alias("label")), "top_id", "left")


def best_matches(df: DataFrame, key: str, field: str, vectors: dict[str, Sequence[float]]) -> DataFrame:
    """(id, score, match): J15: for each of a few query vectors its highest cosine among the rows, to 6 decimals, and the row that has it, the smaller key
    when equal; one pass, no join."""
    names = sorted(vectors)
    dim = len(vectors[names[0]]) if names else 0
    q = unit(np.array([vectors[n] for n in names], np.float32)) if names else np.empty((0, 0))
    rows = df.select(F.col(key).alias("k"), F.col(field).cast("array<float>").alias("x")).where("x IS NOT NULL")
    kind = dict(rows.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[float, object]] = {}
        for batch in batches:
            at, x = unpack(batch.column(1), dim)
            if not len(x) or not names:
                continue
            keys = np.array(batch.column(0).take(pa.array(at)).to_pylist(), dtype=object)
            order = np.argsort(keys, kind="stable")
            s = np.round(unit(x)[order] @ q.T, 6)
            for j, i in enumerate(s.argmax(0).tolist()):  # the first of equal ones has the smallest key
                found = (-float(s[i, j]), keys[order[i]])
                best[j] = min(best.get(j, found), found)
        hit = sorted(best)
        yield pa.RecordBatch.from_pydict({"id": [names[j] for j in hit], "score": [-best[j][0] for j in hit], "match": [best[j][1] for j in hit]}, schema=pa.schema([("id", pa.string()), ("score", pa.float64()), ("match", batch_type)]))

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(rows.schema["k"].dataType)
    found = rows.mapInArrow(run, f"id string, score double, match {kind}")
    return found.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "match")).alias("b")).select("id", (-F.col("b.s")).alias("score"), F.col("b.match").alias("match"))


def novelty(matches: DataFrame, wanted: DataFrame, history: DataFrame, now_ms: int) -> DataFrame:
    """(id, score, status, match, age_days): V13: whether what a post says was said before.

    ``matches``: of ``best_matches``; ``wanted``: (id, has) of all posts asked about, ``has`` whether there is a vector;
    ``history``: (match, posted_ms). A missing date counts as 1970. Without a vector nothing is known.
    """
    rows = wanted.join(matches, "id", "left").join(history, "match", "left")
    score = F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0))
    age = (F.lit(now_ms) - F.coalesce("posted_ms", F.lit(0))) / float(S.DAY_MS)
    covered = (score >= S.NOVELTY_COVERED) & (score < S.NOVELTY_POSTED)
    status = F.when(~F.col("has"), "unknown").when(score >= S.NOVELTY_POSTED, "posted").when(covered & (age >= S.REFRESH_DAYS), "refresh_candidate").when(covered, "recently_covered").otherwise("new")
    known = F.col("has") & (score >= S.NOVELTY_COVERED)
    return rows.select("id", F.when(F.col("has"), score).otherwise(0.0).alias("score"), status.alias("status"), F.when(known, F.col("match")).alias("match"), F.when(F.col("has") & covered, F.floor(age + 0.5)).alias("age_days"))


#: Posts and drafts of a block; the most blocks of a period's posts while one block would hold them all.
BLOCK_POSTS, BLOCK_DRAFTS, MOST_SPREAD = 65_536, 32_768, 8
#: Similarities that a task holds at once.
_TILE = 1 << 22


def draft_blocks(posts: DataFrame, drafts: DataFrame, days: int = S.DRAFT_DAYS) -> DataFrame:
    """(period, db, pb, side, day, name, archetype, x): posts (side 1) and drafts (side 0) in blocks that hold every pair of a post and a draft of its day
    and the ``days`` before in exactly one; the drafts of a block come first, both by day.

    A period is as long as the window, so a post meets two periods at most and a draft is of one. Large periods are a grid of blocks of their posts and
    drafts. Both inputs are read twice: let them be written tables.
    """
    period = lambda day: F.floor(F.unix_date(day) / (days + 1))
    p = posts.where("id IS NOT NULL AND day IS NOT NULL").select(F.explode(F.array_distinct(F.array(period(F.date_sub("day", days)), period(F.col("day"))))).alias("period"), "day", "id", "x")
    d = drafts.where("draft IS NOT NULL AND day IS NOT NULL").select(period(F.col("day")).alias("period"), "day", "draft", "archetype", "y")
    blocks = lambda n, size: F.ceil(F.col(n) / size)
    most = F.greatest(F.least(blocks("np", BLOCK_POSTS // MOST_SPREAD), F.lit(MOST_SPREAD)), blocks("np", BLOCK_POSTS))
    sizes = p.groupBy("period").agg(F.count("*").alias("np")).join(d.groupBy("period").agg(F.count("*").alias("nd")), "period")
    sizes = F.broadcast(sizes.select("period", most.alias("pbs"), blocks("nd", BLOCK_DRAFTS).alias("dbs")))  # a row a period
    all_of, one_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)), lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    p = p.join(sizes, "period").select("period", all_of("dbs").alias("db"), one_of("id", "pbs").alias("pb"), F.lit(1).alias("side"), "day", F.col("id").alias("name"), F.lit(None).cast("string").alias("archetype"), F.col("x").cast("array<float>").alias("x"))
    d = d.join(sizes, "period").select("period", one_of("draft", "dbs").alias("db"), all_of("pbs").alias("pb"), F.lit(0).alias("side"), "day", F.col("draft").alias("name"), "archetype", F.col("y").cast("array<float>").alias("x"))
    return clustered(p.unionByName(d), "period", "db", "pb").sortWithinPartitions("period", "db", "pb", "side", "day")


def draft_matches(posts: DataFrame, drafts: DataFrame, dim: int, days: int = S.DRAFT_DAYS, least: float = S.DRAFT_SIMILAR) -> DataFrame:
    """(id, draft, archetype, similarity): J16: each post (id, day, x) with the most similar draft (draft, day, archetype, y) of its day and the ``days`` before.

    Products of blocks of vectors, so no pair is a row; the smaller draft id when equal. Posts whose best is under ``least`` have no row.
    """

    def work(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        first = int((t["side"].to_numpy() == 0).sum())
        (a, y), (b, x) = (unpack(part["x"], dim) for part in (t.slice(0, first), t.slice(first)))
        if not len(a) or not len(b):
            return
        left, right = t.slice(0, first).select(["name", "archetype", "day"]).take(pa.array(a)), t.slice(first).select(["name", "day"]).take(pa.array(b))
        x, y = unit(x), unit(y)
        of, at = (c["day"].cast(pa.int32()).to_numpy() for c in (left, right))
        order = pc.sort_indices(left, sort_keys=[("name", "ascending"), ("archetype", "ascending")], null_placement="at_start").to_numpy().astype(np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        # pairs (post, draft) of one id are none
        same = pc.index_in(left["name"], value_set=(names := right["name"].unique())).to_numpy(zero_copy_only=False)
        kind = pc.index_in(right["name"], value_set=names).to_numpy(zero_copy_only=False)
        own = np.argsort(np.where(np.isnan(same := same.astype(float)), -1, same), kind="stable")
        codes = np.where(np.isnan(same), -1, same)[own]
        start, end = np.searchsorted(codes, kind, "left"), np.searchsorted(codes, kind, "right")
        own_post = np.repeat(np.arange(len(kind)), end - start)
        own_draft = own[np.arange(len(own_post)) - np.repeat(np.cumsum(end - start) - (end - start), end - start) + np.repeat(start, end - start)]
        posts_, drafts_, scores = [], [], []
        edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        for i0, i1 in zip(edges, edges[1:]):
            lo, hi = int(np.searchsorted(of, at[i0] - days, "left")), int(np.searchsorted(of, at[i0], "right"))
            if lo == hi:
                continue
            step = max(1, _TILE // (hi - lo))
            for r in range(i0, i1, step):
                s = x[r : min(r + step, i1)] @ y[lo:hi].T
                f, l = np.searchsorted(own_post, [r, r + len(s)])
                inside = (own_draft[f:l] >= lo) & (own_draft[f:l] < hi)
                s[own_post[f:l][inside] - r, own_draft[f:l][inside] - lo] = -np.inf
                top = np.round(s.max(1), 6)
                top[top < least] = np.inf  # none is kept
                i, j = np.nonzero(s >= (top - 6e-7)[:, None])  # all that may round to the top
                hit = np.round(s[i, j], 6) == top[i]
                i, j = i[hit], j[hit]
                if len(i):
                    cut = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                    posts_.append(i[cut] + r)
                    drafts_.append(order[np.minimum.reduceat(rank[lo + j], cut)])
                    scores.append(top[i[cut]])
        if posts_:
            best = left.take(pa.array(np.concatenate(drafts_)))
            columns = [right["name"].take(pa.array(np.concatenate(posts_))), best["name"], best["archetype"]]
            found = pa.table([*[c.cast(pa.string()) for c in columns], pa.array(np.concatenate(scores))], names=["id", "draft", "archetype", "s"])
            yield from found.combine_chunks().to_batches()

    scored_ = draft_blocks(posts, drafts, days).mapInArrow(by_group(["period", "db", "pb"], work), "id string, draft string, archetype string, s double")
    best = scored_.groupBy("id").agg(F.min(F.struct((-F.col("s")).alias("n"), "draft", "archetype")).alias("b"))
    return best.select("id", "b.draft", "b.archetype", (-F.col("b.n")).alias("similarity")).where(F.col("similarity") >= least)
