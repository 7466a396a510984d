"""Near-duplicate texts against brute force."""

import datetime as dt

import numpy as np
import regex
from pyspark.sql import functions as F

from murmur.llm import neardup as nd

T = [dt.datetime(2026, 1, d) for d in (1, 2)]
SCHEMA = "id string, content string, scraped_at timestamp"
#: Columns whose names clash with those used inside.
CLASH = {"cls": 1, "sk": 2, "v": 3, "x": "y", "k": 0, "a": 0, "b": 0}


def texts(n=150, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for g in range(n):
        base = list(rng.choice(words, int(rng.integers(35, 120))))
        out.append((f"t{g:03d}-0", " ".join(base)))
        for k in range(1, int(rng.integers(1, 5))):
            other = list(base)
            for _ in range(int(rng.integers(0, 7))):
                at = int(rng.integers(0, len(other)))
                kind = rng.integers(0, 3)
                if kind == 0:
                    other[at] = str(rng.choice(words))
                elif kind == 1:
                    other.insert(at, str(rng.choice(words)))
                else:
                    other = other[at:] + other[:at]
            out.append((f"t{g:03d}-{k}", " ".join(other).upper() if k % 2 else ", ".join(other)))
    return out


def overlaps(data, run, least, words=30):
    sets = {}
    for i, t in data:
        w = regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
        if len(w) >= max(words, run):
            sets[i] = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def test_pairs_against_brute_force(spark):
    data = texts()
    long = " ".join(f"x{i}" for i in range(30_000))
    data += [("copy1", data[0][1]), ("copy2", data[0][1]), ("long1", long), ("long2", long + " more"), ("short", "a b c"), ("blank", " \n"), ("empty", ""), ("dots", "... !!!")]
    frame = [(i, t, T[1]) for i, t in data] + [("none", None, T[1]), (None, data[0][1], T[1]), (data[3][0], data[50][1], T[0])] + [(i, t, T[1]) for i, t in data[:5]]
    df = spark.createDataFrame(frame, SCHEMA).repartition(5).withColumns({n: F.lit(x) for n, x in CLASH.items()})
    for run, least in ((3, 0.6), (5, 0.8)):
        links, members = nd.pairs(df, "content", run=run, overlap=least)
        rows = nd.record_pairs(links, members).collect()
        got, want = {tuple(r) for r in rows}, overlaps(data, run, least)
        assert len(rows) == len(got) and got <= want
        assert len(got) >= 0.99 * len(want)
        assert {("copy1", "copy2"), ("long1", "long2")} <= got


def test_nothing(spark):
    df = spark.createDataFrame([("a", None, T[0]), ("b", "too short", T[0])], SCHEMA)
    for d in (df, df.limit(0)):
        links, members = nd.pairs(d, "content")
        assert links.count() == 0 and members.count() == 0


def test_allocation_is_cheapest():
    from itertools import product

    rng = np.random.default_rng(1)
    cost = {(p, t): float(rng.integers(1, 50)) * (1 + 3 * t) for p in range(5) for t in (0, 1)}
    for budget in range(1, 11):
        t = nd.allocate(cost, 5, [0, 1], budget)
        price = lambda a: sum(cost.get((p, x), 0) if x >= 0 else 0 for p, x in enumerate(a))
        best = min(price(a) for a in product((-1, 0, 1), repeat=5) if sum(x + 1 for x in a) >= budget)
        assert sum(x + 1 for x in t) >= budget and price(t) == best


def test_pigeonhole_never_misses():
    rng = np.random.default_rng(2)
    parts = [list(range(4 * p, 4 * p + 4)) for p in range(nd.COORDINATES // 4)]
    chosen = [int(x) for x in rng.integers(-1, 2, len(parts))]
    most = sum(t + 1 for t in chosen) - 1
    for _ in range(50):
        a = rng.integers(0, 1 << 16, (1, nd.COORDINATES)).astype(np.uint16)
        b = a.copy()
        at = rng.choice(nd.COORDINATES, most, replace=False)
        b[0, at] ^= 1
        hit = any(set(nd.probe_keys(a, p, c, t)[0]) & set(nd.probe_keys(b, p, c, t)[0]) for p, (c, t) in enumerate(zip(parts, chosen)) if t >= 0)
        assert hit


def test_heavy_keys_are_joined_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 16)
    monkeypatch.setattr(nd, "HEAVY", 40)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(80)]
    data = []
    for k in range(150):  # one text's edits are half of all
        other = list(base)
        for _ in range(int(rng.integers(1, 6))):
            other[int(rng.integers(0, 80))] = f"e{rng.integers(0, 9999)}"
        data.append((f"h{k:03d}", " ".join(other)))
    data += texts(40, seed=9)
    df = spark.createDataFrame([(i, t, T[0]) for i, t in data], SCHEMA)
    seen = []
    real = nd.heavy_keys
    monkeypatch.setattr(nd, "heavy_keys", lambda *a: seen.append(real(*a)) or seen[-1])
    got = {tuple(r) for r in nd.record_pairs(*nd.pairs(df, "content", run=3, overlap=0.6, least_words=30)).collect()}
    want = overlaps(data, 3, 0.6)
    assert seen[0] and max(seen[0].values()) > 48
    assert got <= want and len(got) >= 0.99 * len(want)


def test_low_overlaps_have_an_allocation_or_raise():
    cost = {(p, t): 1.0 for p in range(28) for t in range(4)}
    assert nd.thresholds(cost, 28, 0.2, [0, 1]) is None
    t = nd.thresholds(cost, 28, 0.2, [0, 1, 2, 3])
    assert nd.miss(t, 0.2) <= nd.MISS
    assert nd.test_miss(0.6) < 1e-4


def test_short_texts_count_by_default(spark):
    df = spark.createDataFrame([("a", "one two three four five", T[0]), ("b", "One, two three four FIVE", T[0]), ("c", "one two three four", T[0])], SCHEMA)
    links, members = nd.pairs(df, "content")
    assert nd.record_pairs(links, members).collect() == [("a", "b")]
