"""Similar vectors and clusters against brute force."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.llm import clusters, knn
from murmur.llm import vectors as V

SCHEMA = "id string, x array<float>, content string, scraped_at timestamp"
T = [dt.datetime(2026, 1, d) for d in (1, 2, 3)]
#: Columns whose names clash with those used inside.
CLASH = {"k": 1, "v": 2, "cell": 3, "h0": 4, "a": "q", "n": 0, "sim": 0.5}
LONG = " ".join(f"word{i}" for i in range(40))


def planted(groups=60, size=6, dim=24, seed=0, copies=40):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(groups, dim))
    out = [(f"p{g:03d}-{k}", (b + rng.normal(size=dim) * rng.choice([0.05, 0.3])).astype(np.float32).tolist()) for g, b in enumerate(base) for k in range(size)]
    out += [(f"s{k:03d}", rng.normal(size=dim).astype(np.float32).tolist()) for k in range(300)]
    out += [(f"c{k:03d}", out[0][1]) for k in range(copies)]
    return out


def lists(vectors, k, least):
    ids = sorted(vectors)
    x = V.unit(np.array([vectors[i] for i in ids], np.float32))
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -1)
    return {(ids[i], ids[j]) for i in range(len(ids)) for j in np.lexsort((np.arange(len(ids)), -s[i]))[:k] if s[i, j] >= least}


def dirty(dim=24):
    ok = [1.0] * dim
    return [("bad-null", None, None, T[0]), ("bad-zero", [0.0] * dim, None, T[0]), ("bad-short", [1.0], None, T[0]), ("bad-nan", [math.nan] + ok[1:], None, T[0]), ("bad-hole", [None] + ok[1:], None, T[0]), ("bad-inf", [math.inf] + ok[1:], None, T[0]), (None, ok, None, T[0]), ("old", ok, None, T[0]), ("old", None, None, T[1])]


@pytest.mark.parametrize("block", [4096, 16])
def test_lists_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    data = planted()
    frame = [(i, x, None, T[1]) for i, x in data] + [(data[5][0], data[200][1], None, T[0])] + [(i, x, None, T[1]) for i, x in data[:9]] + dirty()
    df = spark.createDataFrame(frame, SCHEMA).repartition(5).withColumns({n: F.lit(x) for n, x in CLASH.items()})
    got = knn.similar(df, {"x": 24}, k=10, least=0.8, slack=0.2)
    pairs = {(r["id_a"], r["id_b"]) for r in got.collect()}
    want = lists(dict(data), 10, 0.8)
    assert len(pairs & want) >= 0.98 * len(want) and len(pairs - want) <= 0.02 * len(want)
    assert got.groupBy("id_a").count().agg(F.max("count")).first()[0] == 10
    assert not any("bad" in x or x == "old" for p in pairs for x in p)


def test_lists_of_copies_and_nothing(spark):
    df = spark.createDataFrame([(f"i{k:02d}", [1.0, 0.0], None, T[0]) for k in range(20)], SCHEMA)
    got = {}
    for r in knn.similar(df, {"x": 2}, k=3).collect():
        got.setdefault(r["id_a"], []).append(r["id_b"])
    assert sorted(got["i00"]) == ["i01", "i02", "i03"] and sorted(got["i19"]) == ["i00", "i01", "i02"] and len(got) == 20
    assert knn.similar(df.limit(0), {"x": 2}).count() == 0
    assert knn.similar(spark.createDataFrame(dirty(), SCHEMA), {"x": 24}).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    u, w = V.unit(rng.normal(size=(200, 32))), V.unit(rng.normal(size=(150, 32)))
    upper, margin = V.tile(V.quantised(u), V.quantised(w))
    exact = u @ w.T
    assert (exact <= upper + 1e-6).all() and (exact >= upper - 2 * margin - 1e-6).all() and margin.max() < 0.05


def brute_clusters(vectors, least=0.75, size=3):
    ids = sorted(vectors)
    x = V.unit(np.array([vectors[i] for i in ids], np.float32))
    s = np.round(x @ x.T, 6) >= least
    np.fill_diagonal(s, False)
    adj = [set(np.flatnonzero(r)) for r in s]
    found = []

    def grow(r, p, q):
        if not p and not q:
            found.append(r)
        for v in list(p):
            grow(r | {v}, p & adj[v], q & adj[v])
            p = p - {v}
            q = q | {v}

    grow(set(), set(range(len(ids))), set())
    used, out = set(), set()
    for g in sorted((g for g in found if len(g) >= size), key=lambda g: (-len(g), sorted(g))):
        left = g - used
        if len(left) >= size:
            used |= left
            out |= {(ids[v], ids[min(left)]) for v in left}
    return out


@pytest.mark.parametrize("block", [4096, 16])
def test_clusters_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    data = planted(groups=25, size=5, copies=4)
    frame = [(i, x, None, T[1]) for i, x in data] + [(i, x, None, T[1]) for i, x in data[:7]] + dirty()
    df = spark.createDataFrame(frame, SCHEMA).repartition(4).withColumns({n: F.lit(x) for n, x in CLASH.items()})
    found = clusters.clusters(df, "x", 24).collect()
    got, want = {(r["id"], r["cluster_id"]) for r in found}, brute_clusters(dict(data))
    assert len(found) == len(got)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


@pytest.mark.parametrize("copies", [1, 3])
def test_members_linked_only_as_visitors_keep_their_cluster(spark, monkeypatch, copies):
    # centres at 0 and 60 degrees: 29 degrees is at home in the first cell and visits the second, 45 and 50 stay in the second
    angle = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d))]
    monkeypatch.setattr(clusters, "seed_centres", lambda *a, **k: np.array([angle(0), angle(60)], np.float32))
    monkeypatch.setattr(clusters, "LLOYD_ROUNDS", 0)
    rows = [(f"a{c}", angle(29), None, T[0]) for c in range(copies)] + [("b", angle(45), None, T[0]), ("c", angle(50), None, T[0]), ("far", angle(200), None, T[0])]
    found = clusters.clusters(spark.createDataFrame(rows, SCHEMA), "x", 2).collect()
    assert {(r["id"], r["cluster_id"]) for r in found} == {(r[0], "a0") for r in rows[:-1]}


def test_vectors_are_lent_by_text(spark):
    rows = [(f"a{k}", [1.0, 0.01 * k], LONG if k == 0 else None, T[0]) for k in range(2)] + [("b", None, f"  {LONG}\n", T[0]), ("c", [0.0, 0.0], "short", T[0]), ("d", [0.0, 1.0], "short", T[0]), ("0", None, LONG, T[0])]
    found = clusters.clusters(spark.createDataFrame(rows, SCHEMA), "x", 2, text="content")
    assert {(r["id"], r["cluster_id"]) for r in found.collect()} == {(i, "0") for i in ("0", "a0", "a1", "b")}
    d = clusters.describe(found).first()
    assert (d["cluster_id"], d["size"], len(d["typical"])) == ("0", 4, 3)


def test_copies_alone_are_a_cluster_and_nothing_is_none(spark):
    df = spark.createDataFrame([(f"i{k}", [1.0, 2.0], None, T[0]) for k in range(5)] + [("x", [-1.0, 0.0], None, T[0])], SCHEMA)
    assert {(r["id"], r["cluster_id"]) for r in clusters.clusters(df, "x", 2).collect()} == {(f"i{k}", "i0") for k in range(5)}
    assert clusters.clusters(df.limit(0), "x", 2, text="content").count() == 0


def test_overlapping_groups():
    #  0-1-2-3 all similar, 3-4-5 and 4-5-6: the larger group keeps 3
    edges = [(a, b) for a in range(4) for b in range(a)] + [(4, 3), (5, 3), (5, 4), (6, 4), (6, 5)]
    bits = [0] * 7
    for a, b in edges:
        bits[a] |= 1 << b
        bits[b] |= 1 << a
    assert sorted(map(sorted, clusters.maximal_groups(bits))) == [[0, 1, 2, 3], [3, 4, 5], [4, 5, 6]]
    a = np.zeros((7, 7), bool)
    for x, y in edges:
        a[x, y] = a[y, x] = True
    assert sorted(map(sorted, clusters.greedy_groups(a, np.ones(7))))[0] == [0, 1, 2, 3]


def kept(adjacent, weight, size):
    """What all maximal groups keep, listed."""
    total = lambda g: sum(weight[v] for v in g)
    used, out = set(), []
    for g in sorted((sorted(g) for g in clusters.maximal_groups(adjacent)), key=lambda g: (-total(g), g)):
        left = [v for v in g if v not in used]
        if total(left) >= size:
            used |= set(left)
            out.append(left)
    return out


@pytest.mark.parametrize("share", [0.15, 0.5, 0.85])
def test_largest_groups_are_those_of_the_full_list(share):
    rng = np.random.default_rng(int(share * 100))
    for n in [1, 2, 5, 9, 14, 20] * 15:
        a = np.triu(rng.random((n, n)) < share, 1)
        bits = [sum(1 << j for j in range(n) if a[i, j] or a[j, i]) for i in range(n)]
        weight = rng.choice([1, 1, 1, 2, 5], n).tolist()
        assert list(clusters.largest_groups(bits, weight, 3)) == kept(bits, weight, 3)


def test_groups_of_a_component_of_over_300_follow_the_definition():
    # vectors on an arc: a group is a window of 41 degrees, and the full list is short
    import pyarrow as pa

    d = np.sort(np.random.default_rng(4).uniform(0, 160, 400))
    x = np.stack([np.cos(np.radians(d)), np.sin(np.radians(d))], 1).astype(np.float32)
    near = np.round(V.unit(x) @ V.unit(x).T, 6) >= 0.75
    np.fill_diagonal(near, False)
    bits = [int.from_bytes(np.packbits(r, bitorder="little").tobytes(), "little") for r in near]
    rows = pa.RecordBatch.from_arrays([pa.array(["g"] * 400), pa.array([f"i{k:03d}" for k in range(400)]), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([1] * 400)], names=["grp", "id", "x", "n"])
    got = {}
    for b in clusters._grouped(2, 0.75, 3)(iter([rows])):
        for r in b.to_pylist():
            got.setdefault(r["cluster"], []).append(int(r["id"][1:]))
    assert sorted(map(sorted, got.values())) == sorted(kept(bits, [1] * 400, 3))


def test_a_subject_of_over_8192_vectors_is_one_cluster(spark):
    rng = np.random.default_rng(5)
    x = np.array([1.0] + [0.0] * 7) + rng.normal(size=(9000, 8)) * 0.05
    df = spark.createDataFrame([(f"i{k:04d}", v.tolist(), None, T[0]) for k, v in enumerate(x)], SCHEMA)
    found = clusters.clusters(df, "x", 8).groupBy("cluster_id").count().collect()
    assert [(r["cluster_id"], r["count"]) for r in found] == [("i0000", 9000)]


def test_texts_as_features(spark):
    from murmur.llm.features import text_vectors

    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(500)]
    base = [list(rng.choice(words, 60, replace=False)) for _ in range(20)]
    rows = [(f"t{g:02d}-{k}", None, " ".join(b[k:] + ["the"] * 9), T[0]) for g, b in enumerate(base) for k in range(3)] + [("short", None, "the end", T[0]), ("none", None, None, T[0])]
    df = spark.createDataFrame(rows, SCHEMA).drop("x").repartition(3)
    v = text_vectors(df, "id", "content", "scraped_at")
    got = {r["id"]: r["x"] for r in v.collect()}
    assert len(got) == 62 and got["short"] is None and got["none"] is None
    assert np.dot(got["t00-0"], got["t00-2"]) > 0.9 > 0.5 > abs(np.dot(got["t00-0"], got["t01-0"]))
    found = clusters.clusters(v, "x", 128).groupBy("cluster_id").count().collect()
    assert len(found) == 20 and all(r["count"] == 3 for r in found)


def test_cells_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(V, "AT_ONCE", 8)
    monkeypatch.setattr(V, "PER_CELL", 8)
    monkeypatch.setattr(V, "SAMPLE", 60)
    data = planted(groups=120, copies=0)
    rows = spark.createDataFrame(data, "id string, x array<float>").repartition(4)
    centres = V.place_cells(rows, len(data), 24)
    assert V.cells_for(len(data)) * 0.5 <= len(centres) <= V.cells_for(len(data)) * 2 and centres.shape[1] == 24
    got = {(r["id_a"], r["id_b"]) for r in knn.similar(spark.createDataFrame([(i, x, None, T[0]) for i, x in data], SCHEMA), {"x": 24}, k=10, least=0.8).collect()}
    want = lists(dict(data), 10, 0.8)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_the_slack_is_what_true_partners_need(spark, monkeypatch):
    data = planted(groups=150, copies=0)
    rows = spark.createDataFrame(data, "id string, x array<float>").repartition(4)
    centres = V.place_cells(rows, len(data), 24)
    u, w = V.partners(rows, len(data), 24, 10, 0.8)
    assert (np.einsum("ij,ij->i", u, w) >= 0.8 - 1e-5).all() and len(u) > 500
    assert len({x.tobytes() for x in u}) <= len(data)
    slack = V.slack_for(centres, u, w)
    hu, hw = V.nearest(u, centres), V.nearest(w, centres)
    dot = lambda x, c: np.einsum("ij,ij->i", x, centres[c])
    meet = (dot(w, hw) - dot(w, hu) <= slack) | (dot(u, hu) - dot(u, hw) <= slack)
    assert V.MEET - 0.005 <= meet.mean()
    assert V.slack_for(centres, u[:0], w[:0], default=0.07) == 0.07 and V.slack_for(centres, u[:5], w[:5], default=0.5) == 0.5


def test_members_of_a_hot_class_stay_where_they_are(spark, monkeypatch):
    from murmur.operators import skew

    monkeypatch.setattr(skew, "LEAST_ROWS", 30)
    data = planted(groups=30, copies=400)
    got = {(r["id_a"], r["id_b"]) for r in knn.similar(spark.createDataFrame([(i, x, None, T[0]) for i, x in data], SCHEMA).repartition(5), {"x": 24}, k=5, least=0.8, slack=0.3).collect()}
    want = lists(dict(data), 5, 0.8)
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)

