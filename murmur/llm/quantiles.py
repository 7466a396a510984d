"""Percentiles per group from mergeable hierarchies of randomized compactors.

Level l of a group's sketch holds values of weight 2^l. A level of more than k values is sorted and every other
value, from a random start, moves one level up; an odd one stays. Sketches merge level by level, so those of
partitions or days combine in any order, and total weights stay exact. Each compaction of level l moves a rank by
0 or 2^l with a random sign; the sketch carries the sum of 4^l, so Hoeffding's inequality bounds the rank error
for that very sketch. A group of at most k values is never compacted and therefore exact.

All groups of a partition are compacted together in numpy; a partition sends O(k log(n / k)) values of a group,
whatever the group's size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.cap import positions
from murmur.operators.skew import skew_join
from murmur.sources.shared import stored

#: Values of a level before it is compacted; chance that a stated bound fails; values gathered between compactions.
K, DELTA, CHUNK = 512, 1e-9, 400_000

#: Names of groups in doubt are sent to every task up to this number; beyond it they are joined.
BROADCAST_GROUPS = 1_000_000

STATE = "level int, vals array<double>, var double"


def _number(name: str) -> Column:
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def _compact(frame: pd.DataFrame, k: int, rng: np.random.Generator) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Compact every level of every group that holds more than ``k`` values: (values, variances) as flat tables."""
    variances = []
    done = []
    while len(frame):
        frame = frame.sort_values(["g", "m", "level", "v"], kind="stable", ignore_index=True)
        runs = frame.groupby(["g", "m", "level"], sort=False)
        n, place = runs["v"].transform("size").to_numpy(), runs.cumcount().to_numpy()
        full = n > k
        if not full.any():
            break
        level = frame["level"].to_numpy()
        first = place == 0
        start = rng.integers(0, 2, int((full & first).sum()))
        offset = np.zeros(len(frame), np.int64)
        offset[full & first] = start
        offset = np.maximum.reduceat(offset, np.flatnonzero(first)).repeat(n[first]) if len(frame) else offset
        paired = place < n - (n & 1)
        up = full & paired & ((place & 1) == offset)
        stay = ~full | ~paired
        heads = frame[full & first]
        variances.append(pd.DataFrame({"g": heads["g"], "m": heads["m"], "level": heads["level"], "var": 4.0 ** heads["level"]}))
        frame = frame.assign(level=np.where(up, level + 1, level).astype(np.int32))[up | stay]
    done.append(frame)
    v = pd.concat(variances) if variances else pd.DataFrame({"g": [], "m": [], "level": [], "var": []})
    return pd.concat(done), v


def _rows(frame: pd.DataFrame, var: pd.DataFrame) -> pa.RecordBatch:
    """One row a group, metric and level."""
    frame = frame.sort_values(["g", "m", "level", "v"], kind="stable", ignore_index=True)
    head = frame.drop_duplicates(["g", "m", "level"])
    starts = np.r_[head.index.to_numpy(), len(frame)].astype(np.int32)
    summed = var.groupby(["g", "m", "level"], sort=False, as_index=False)["var"].sum() if len(var) else var
    keys = head[["g", "m", "level"]].assign(**{"i": np.arange(len(head))})
    if len(summed):
        # a level that compaction emptied hands its variance to the level above, which is never empty
        have = keys.merge(summed.assign(level=summed["level"].astype(np.int32)), on=["g", "m", "level"], how="outer", indicator=True)
        lost = have[have["_merge"] == "right_only"].groupby(["g", "m"])["var"].sum()
        keys = have[have["_merge"] != "right_only"].sort_values("i", ignore_index=True)
        keys["var"] = keys["var"].fillna(0.0)
        if len(lost):
            top = keys.drop_duplicates(["g", "m"], keep="last").index
            keys.loc[top, "var"] += [lost.get((g, m), 0.0) for g, m in zip(keys.loc[top, "g"], keys.loc[top, "m"])]
        variance = keys["var"].to_numpy(float)
    else:
        variance = np.zeros(len(keys))
    values = pa.ListArray.from_arrays(pa.array(starts), pa.array(frame["v"].to_numpy(float)))
    return pa.RecordBatch.from_arrays([pa.array(keys["g"]), pa.array(keys["m"].astype(str), pa.string()), pa.array(keys["level"].to_numpy(np.int32)), values, pa.array(variance)], names=["g", "m", "level", "vals", "var"])


def _sketch(columns: list[str], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, parts, size, variances = np.random.default_rng(11), [], 0, []
        for batch in batches:
            g = batch.column(0).to_pandas()
            for i, c in enumerate(columns):
                v = batch.column(1 + i).to_numpy(zero_copy_only=False).astype(float)
                ok = ~np.isnan(v)
                parts.append(pd.DataFrame({"g": g[ok], "m": c, "level": np.zeros(int(ok.sum()), np.int32), "v": v[ok]}))
                size += int(ok.sum())
            if size > CHUNK:
                frame, var = _compact(pd.concat(parts), k, rng)
                parts, variances, size = [frame], [*variances, var], 0
        if parts:
            frame, var = _compact(pd.concat(parts), k, rng)
            variances.append(var)
            if len(frame):
                yield _rows(frame, pd.concat(variances))

    return run


def _flat(batch: pa.RecordBatch) -> tuple[pd.DataFrame, pd.DataFrame]:
    g, m, level = batch.column(0).to_pandas(), batch.column(1).to_pandas(), batch.column(2).to_pandas()
    lists = batch.column(3)
    size = np.diff(lists.offsets.to_numpy())
    frame = pd.DataFrame({"g": np.repeat(g.to_numpy(), size), "m": np.repeat(m.to_numpy(), size), "level": np.repeat(level.to_numpy(), size), "v": lists.flatten().to_numpy()})
    return frame, pd.DataFrame({"g": g, "m": m, "level": level, "var": batch.column(4).to_pandas()})


def _merge(k: int, finish):
    """Merge the sorted rows of a partition, whole groups at a time; a group larger than a chunk is compacted on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, frames, variances, size = np.random.default_rng(13), [], [], 0
        for batch in batches:
            frame, var = _flat(batch)
            frames.append(frame)
            variances.append(var)
            size += len(frame)
            if size > CHUNK:
                frame, var = _compact(pd.concat(frames), k, rng)
                var = pd.concat([*variances, var])
                last = batch.column(0)[batch.num_rows - 1].as_py()
                open_, vopen = (frame["g"] == last).to_numpy(), (var["g"] == last).to_numpy()
                if (~open_).any():
                    yield finish(frame[~open_], var[~vopen])
                frames, variances, size = [frame[open_]], [var[vopen]], 0
        if frames:
            frame, var = _compact(pd.concat(frames), k, rng)
            if len(frame):
                yield finish(frame, pd.concat([*variances, var]))

    return run


def sketches(df: DataFrame, group: str, columns: Sequence[str], k: int = K) -> DataFrame:
    """(group, metric, level, vals, var): sketches of each partition of ``df``, ready to be stored or merged.

    ``metric`` is the column's name. Null groups, nulls and NaN do not count.
    """
    rows = df.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), *[_number(c).alias(f"c{i}") for i, c in enumerate(columns)])
    made = rows.mapInArrow(_sketch(list(columns), k), f"g {dict(rows.dtypes)['g']}, m string, {STATE}")
    return made.select(F.col("g").alias(group), F.col("m").alias("metric"), "level", "vals", "var")


def _gathered(state: DataFrame, group: str) -> DataFrame:
    rows = state.select(F.col(group).alias("g"), F.col("metric").alias("m"), "level", "vals", "var")
    return rows.repartition("g").sortWithinPartitions("g", "m", "level")


def merge(state: DataFrame, group: str, k: int = K) -> DataFrame:
    """The sketches of ``state`` combined into one a group and metric, in the same form."""
    rows = _gathered(state, group)
    made = rows.mapInArrow(_merge(k, _rows), f"g {dict(rows.dtypes)['g']}, m string, {STATE}")
    return made.select(F.col("g").alias(group), F.col("m").alias("metric"), "level", "vals", "var")


def _answers(ps: list[float], delta: float):
    def finish(frame: pd.DataFrame, var: pd.DataFrame) -> pa.RecordBatch:
        frame = frame.sort_values(["g", "m", "v"], kind="stable", ignore_index=True)
        total = var.groupby(["g", "m"], sort=False)["var"].sum() if len(var) else {}
        heads = frame.drop_duplicates(["g", "m"])
        starts = heads.index.to_numpy()
        v, w = frame["v"].to_numpy(float), (1 << frame["level"].to_numpy(np.int64))
        out: dict[str, list] = {"g": [], "m": [], "n": [], "value": [], "lo": [], "hi": []}
        for a, b, g, m in zip(starts, np.r_[starts[1:], len(frame)], heads["g"], heads["m"]):
            cum = np.cumsum(w[a:b])
            n = int(cum[-1])
            slack = np.sqrt(2 * float(total.get((g, m), 0.0)) * np.log(2 / delta))
            h = np.array(ps) * (n - 1)
            at = lambda i: v[a:b][np.searchsorted(cum, np.clip(i, 0, n - 1), side="right")]  # noqa: E731, B023
            low = np.floor(h)
            value = at(low) + (at(low + 1) - at(low)) * (h - low)
            # the smallest value whose counted rank reaches a rank less, or more, the bound; beyond the ends nothing is known
            first, last = np.floor(h - slack), np.ceil(h + 1 + slack)
            lo, hi = (value, value) if slack == 0 else (np.where(first < 0, -np.inf, at(first)), np.where(last > n - 1, np.inf, at(last)))
            for key, x in zip(out, (g, m, n, value.tolist(), lo.tolist(), hi.tolist())):
                out[key].append(x)
        lists = pa.list_(pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(out["g"]), pa.array(out["m"], pa.string()), pa.array(out["n"], pa.int64()), *[pa.array(out[c], lists) for c in ("value", "lo", "hi")]], names=list(out))

    return finish


def percentiles(state: DataFrame, group: str, ps: Sequence[float], k: int = K, delta: float = DELTA) -> DataFrame:
    """(group, metric, n, value, lo, hi): arrays with one entry for each of ``ps``.

    ``value`` interpolates linearly between ranks; the true percentile is between ``lo`` and ``hi`` except with
    a chance below ``delta``; they are infinite where the bound reaches beyond the values. All three agree for groups that were
    never compacted.
    """
    rows = _gathered(state, group)
    made = rows.mapInArrow(_merge(k, _answers(list(ps), delta)), f"g {dict(rows.dtypes)['g']}, m string, n long, value array<double>, lo array<double>, hi array<double>")
    return made.select(F.col("g").alias(group), F.col("m").alias("metric"), "n", "value", "lo", "hi")


def exact_percentiles(df: DataFrame, group: str, wanted: DataFrame) -> DataFrame:
    """Exact percentiles by selection within sketch bounds.

    ``df``: (group, metric, value). ``wanted``: (group, metric, p, lo, hi) with lo and hi around the
    percentile. Values below lo are only counted; those between lo and hi, a share of about twice the rank
    error, are ranked by a global sort, so no task holds a group. Result: (group, metric, p, exact); null if a bound missed.
    """
    keys = ["g", "m"]
    w = wanted.select(F.col(group).alias("g"), F.col("metric").alias("m"), "p", "lo", "hi")
    names = w.select(*keys).distinct()
    if names.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        names = F.broadcast(names)
    rows = df.select(F.col(group).alias("g"), F.col("metric").alias("m"), F.col("value").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    rows = stored(rows.join(names, keys, "left_semi"), "values")
    counts = stored(rows.groupBy(*keys).agg(F.count("*").alias("n")), "counts")
    below = skew_join(rows, w, keys, counts).groupBy(*keys, "p", "lo", "hi").agg(F.count_if(F.col("v") < F.col("lo")).alias("below"))
    asked = stored(below.join(counts, keys), "asked")  # one row a percentile wanted
    inside = skew_join(rows, asked, keys, counts).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).select(*keys, "p", "below", "n", "v")
    ranked = positions(inside, [*keys, "p"], [F.col("v").asc()], "inside").withColumn("h", F.col("p") * (F.col("n") - 1)).withColumn("i", F.col("below") + F.col("rank") - 1)
    first, second = F.floor("h"), F.least(F.floor("h") + 1, F.col("n") - 1)
    picked = ranked.where((F.col("i") == first) | (F.col("i") == second))
    out = picked.groupBy("g", "m", "p", "h").agg(F.max(F.when(F.col("i") == first, F.col("v"))).alias("a"), F.max(F.when(F.col("i") == second, F.col("v"))).alias("b"))
    return out.select(F.col("g").alias(group), F.col("m").alias("metric"), "p", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("h") - F.floor("h"))).alias("exact"))


def score_shapes(df: DataFrame, group: str, score: str, baseline: str, least: int = 15, tail: float = 10.0, drift: float = 3.0, k: int = K) -> DataFrame:
    """(group, kind): groups of at least ``least`` scores whose distribution is unusual.

    ``tail``: the 90th percentile of the score is at least ``tail`` times its median; ``drift``: the median of the
    score is at least ``drift`` times, or at most that part of, the median of the baseline. Nulls and NaN do not
    count; a group without a baseline has no drift. Sketches decide where their bounds leave no doubt; the few
    groups in doubt are decided by exact selection within those bounds.
    """
    found = percentiles(sketches(df, group, [score, baseline], k), group, [0.5, 0.9], k)
    mine, base = F.col("metric") == score, F.col("metric") == baseline
    ends = {"m": (mine, 0), "t": (mine, 1), "b": (base, 0)}
    cells = [F.max(F.when(w, F.get(c, F.lit(i)))).alias(f"{name}{e}") for name, (w, i) in ends.items() for e, c in (("0", "lo"), ("1", "hi"))]
    b = found.groupBy(group).agg(F.max(F.when(mine, F.col("n"))).alias("n"), *cells).where(F.col("n") >= least)
    yes = {"tail": f"t0 >= {tail}D * m1", "drift": f"m0 >= {drift}D * b1 OR m1 <= b0 / {drift}D"}
    maybe = {"tail": f"t1 >= {tail}D * m0", "drift": f"m1 >= {drift}D * b0 OR m0 <= b1 / {drift}D"}
    b = b.select("*", *[F.expr(f"coalesce({e}, false)").alias(f"yes_{x}") for x, e in yes.items()], *[F.expr(f"coalesce({e}, false)").alias(f"maybe_{x}") for x, e in maybe.items()])
    b = stored(b, "shapes")  # one row a group of enough scores
    doubt = "((maybe_tail AND NOT yes_tail) OR (maybe_drift AND NOT yes_drift))"
    listed = lambda marks: F.explode(F.filter(F.array(*[F.when(f, F.lit(x)) for x, f in marks.items()]), lambda x: x.isNotNull())).alias("kind")
    sure = b.where(f"NOT {doubt}").select(group, listed({x: F.col(f"yes_{x}") for x in yes}))
    if b.where(doubt).limit(1).count() == 0:
        return sure
    asked = F.array(*[F.struct(F.lit(score if name != "b" else baseline).alias("metric"), F.lit(0.9 if name == "t" else 0.5).alias("p"), F.col(f"{name}0").alias("lo"), F.col(f"{name}1").alias("hi")) for name in ends])
    wanted = b.where(doubt).select(group, F.explode(asked).alias("w")).select(group, "w.*").where("lo IS NOT NULL")
    values = df.select(group, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), _number(c).alias("value")) for c in (score, baseline)])).alias("e")).select(group, "e.*")
    exact = exact_percentiles(values, group, wanted)
    pick = lambda metric, p, name: F.max(F.when((F.col("metric") == metric) & (F.col("p") == p), F.col("exact"))).alias(name)
    e = exact.groupBy(group).agg(pick(score, 0.5, "m"), pick(score, 0.9, "t"), pick(baseline, 0.5, "b"))
    flags = {"tail": F.expr(f"t >= {tail}D * m"), "drift": F.expr(f"m >= {drift}D * b OR m <= b / {drift}D")}
    return sure.union(e.select(group, listed(flags)))
