"""Top N, caps and percentiles on small cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.llm import cap, quantiles, topn

#: Columns whose names clash with those used inside.
CLASH = {"g": "x", "t": 1, "ns": 2.0, "rank": 9, "c": 0, "pid": 3, "m": "y", "level": 5}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def scored(spark, n=3000, seed=0):
    rng = np.random.default_rng(seed)
    data = [("hot" if k % 3 == 0 else f"g{int(a)}", f"i{k:05d}", float(s)) for k, (a, s) in enumerate(zip(rng.integers(0, 40, n), rng.integers(0, 50, n)))]
    data += [(None, "n1", 1.0), ("g1", None, 9e9), ("g1", "n2", None), ("g1", "n3", math.nan), ("g1", "n4", math.inf), ("g1", "n5", -math.inf), ("z", "z1", -0.0), ("z", "z2", 0.0)]
    return data


def test_top_n_against_brute_force(spark):
    data = scored(spark)
    df = spark.createDataFrame(data, "a string, id string, s double").repartition(7).withColumns({n: F.lit(x) for n, x in CLASH.items()})
    want = {}
    for a, i, s in data:
        if None not in (a, i, s) and s == s:
            want.setdefault(a, []).append((-s, i))
    want = {(a, i, r + 1) for a, v in want.items() for r, (_, i) in enumerate(sorted(v)[:5])}
    assert {(r["a"], r["id"], r["rank"]) for r in topn.top_n(df, "a", "s", "id", 5).collect()} == want


def test_top_n_ties_repeats_and_nothing(spark):
    df = spark.createDataFrame([("a", f"i{k}", 1.0) for k in range(50)] * 2, "a string, id string, s double").repartition(5)
    assert [r["id"] for r in topn.top_n(df, "a", "s", "id", 3).orderBy("rank").collect()] == ["i0", "i0", "i1"]
    assert topn.top_n(df.limit(0), "a", "s", "id", 3).collect() == []
    with pytest.raises(ValueError):
        topn.top_n(df, "a", "s", "id", 0)


def test_top_n_in_small_chunks(spark, monkeypatch):
    data = scored(spark, 500, 4)
    df = spark.createDataFrame(data, "a string, id string, s double").repartition(1)
    want = rows(topn.top_n(df, "a", "s", "id", 2))
    # a chunk of a few rows makes the state be cut down again and again
    frames = topn._local_best(2)
    import pyarrow as pa

    monkeypatch.setattr(topn, "CHUNK", 10)
    table = df.where("a IS NOT NULL AND id IS NOT NULL AND s IS NOT NULL AND NOT isnan(s)").selectExpr("a AS g", "-s AS ns", "id AS t").toArrow()
    out = pa.Table.from_batches(list(frames(iter(table.to_batches(max_chunksize=7))))).to_pandas()
    assert {(r.g, r.t) for r in out.itertuples()} == {(a, i) for a, i, *_ in want}


def test_cap_against_brute_force(spark):
    data = scored(spark)
    df = spark.createDataFrame(data, "a string, id string, q double").repartition(6).withColumns({n: F.lit(x) for n, x in CLASH.items()})
    kept = cap.cap_contributors(df, "a", "q", "id", cap=20)
    want, total = set(), {}
    groups = {}
    for a, i, s in data:
        if a is not None and i is not None:
            groups.setdefault(a, []).append((0 if s is not None and s == s else 1, -s if s is not None and s == s else 0, i))
    for a, v in groups.items():
        total[a] = len(v)
        want |= {(a, i, r + 1) for r, (*_, i) in enumerate(sorted(v)[:20])}
    got = kept.collect()
    assert {(r["a"], r["id"], r["rank"]) for r in got} == want
    assert all(r["total"] == total[r["a"]] for r in got)


def test_cap_by_share_and_nothing(spark):
    df = spark.createDataFrame([("a", f"i{k:02d}", None) for k in range(30)] + [("b", "j", 1.0)] * 2, "a string, id string, q double")
    kept = rows(cap.cap_contributors(df, "a", "q", "id", share=0.1).select("a", "id"))
    assert kept == [("a", "i00"), ("a", "i01"), ("a", "i02"), ("b", "j"), ("b", "j")]
    assert cap.cap_contributors(df.limit(0), "a", "q", "id", cap=3).count() == 0
    with pytest.raises(ValueError):
        cap.cap_contributors(df, "a", "q", "id")


def test_percentiles_are_exact_for_small_groups_and_bounded_for_large(spark):
    rng = np.random.default_rng(5)
    values = {"hot": rng.lognormal(3, 2, 30_000), "small": rng.normal(size=31), "one": np.array([4.0]), "same": np.full(2000, 7.0)}
    data = [(g, float(v)) for g, x in values.items() for v in x] + [("small", None), ("small", math.nan), (None, 1.0), ("empty", None)]
    df = spark.createDataFrame(data, "a string, v double").repartition(9).withColumns({"m": F.lit("w"), "g": F.lit(1)})
    ps = [0.0, 0.1, 0.5, 0.9, 1.0]
    state = quantiles.sketches(df, "a", ["v"], k=128)
    for source in (state, quantiles.merge(state, "a", 128)):
        got = {r["a"]: r for r in quantiles.percentiles(source, "a", ps, 128).collect()}
        assert set(got) == set(values)
        for g, x in values.items():
            assert got[g]["n"] == len(x)
            exact = np.quantile(x, ps)
            assert all(lo <= e <= hi for lo, e, hi in zip(got[g]["lo"], exact, got[g]["hi"]))
            if len(x) <= 128 or g == "same":
                assert got[g]["value"] == pytest.approx(exact.tolist())
        rank = np.searchsorted(np.sort(values["hot"]), got["hot"]["value"][2]) / 30_000
        assert abs(rank - 0.5) < 0.03
    assert quantiles.percentiles(quantiles.sketches(df.limit(0), "a", ["v"]), "a", ps).count() == 0


def test_shapes_in_doubt_are_decided_exactly(spark):
    rng = np.random.default_rng(6)
    data, want = [], set()
    for k in range(40):
        n = 15 if k % 2 else 2500
        x, b = rng.lognormal(3, 1.8, n), rng.lognormal(3.0 + (k % 5 - 2) * 0.55, 1.0, n)
        if k == 7:
            x = np.full(n, 3.0) * b[0]
            b = np.full(n, b[0])
        data += [(f"a{k}", float(v), float(w)) for v, w in zip(x, b)]
        m, t, d = np.quantile(x, 0.5), np.quantile(x, 0.9), np.quantile(b, 0.5)
        want |= {(f"a{k}", "tail")} if t >= 10 * m else set()
        want |= {(f"a{k}", "drift")} if m >= 3 * d or m <= d / 3 else set()
    data += [("few", 1.0, 99.0)] * 14
    df = spark.createDataFrame(data, "a string, s double, b double").repartition(4)
    assert {tuple(r) for r in quantiles.score_shapes(df, "a", "s", "b", k=128).collect()} == want
    assert quantiles.score_shapes(df.limit(0), "a", "s", "b").count() == 0


def test_local_bests_take_linear_time():
    """A million groups in one partition, each once: sorted a bounded number of times."""
    import time

    import pyarrow as pa

    def took(n):
        g = np.random.default_rng(1).permutation(n)
        made = [pa.RecordBatch.from_arrays([pa.array([f"a{x}" for x in p]), pa.array(-(p % 97).astype(float)), pa.array([f"p{x}" for x in p])], names=["g", "ns", "t"]) for p in np.array_split(g, n // 10_000)]
        began = time.perf_counter()
        assert sum(b.num_rows for b in topn._local_best(5)(iter(made))) == n
        return time.perf_counter() - began

    took(100_000)
    assert took(1_000_000) < 30


def test_a_contributor_over_many_partitions(spark):
    """One contributor holds most rows; ranks go on over the ends of the sort's partitions."""
    data = [("hot", f"i{k:05d}", float(k % 50)) for k in range(5000)] + [(f"c{k}", "x", 1.0) for k in range(40)]
    df = spark.createDataFrame(data, "a string, id string, q double").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps all partitions of the sort
    try:
        got = {(r["a"], r["id"]): (r["rank"], r["total"]) for r in cap.ranked_contributors(df, "a", "q", "id").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    hot = sorted((x for x in data if x[0] == "hot"), key=lambda x: (-x[2], x[1]))
    assert [got["hot", i][0] for _, i, _ in hot] == list(range(1, 5001))
    assert all(got[a, "x"] == (1, 1) for a, *_ in data[5000:]) and got["hot", "i00000"][1] == 5000


def test_selection_in_a_hot_group(spark, monkeypatch):
    from murmur.operators import skew

    monkeypatch.setattr(skew, "LEAST_ROWS", 100)
    x = np.random.default_rng(8).lognormal(3, 2, 20_000)
    df = spark.createDataFrame([("hot", "s", float(v)) for v in x] + [("cold", "s", 1.0), ("cold", "s", 3.0), ("other", "s", 9.0)], "g string, metric string, value double").repartition(6)
    ends = [(0.5, float(np.quantile(x, 0.45)), float(np.quantile(x, 0.55))), (0.9, float(np.quantile(x, 0.85)), float(np.quantile(x, 0.95)))]
    wanted = spark.createDataFrame([("hot", "s", *e) for e in ends] + [("cold", "s", 0.5, 1.0, 3.0)], "g string, metric string, p double, lo double, hi double")
    got = {(r["g"], r["p"]): r["exact"] for r in quantiles.exact_percentiles(df, "g", wanted).collect()}
    assert got == {("hot", 0.5): pytest.approx(np.quantile(x, 0.5)), ("hot", 0.9): pytest.approx(np.quantile(x, 0.9)), ("cold", 0.5): 2.0}
