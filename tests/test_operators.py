"""Operators on small cases: edges that the tables do not hold."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.functions.dense import from_blob, to_blob, unpack
from murmur.functions.stemming import stem
from murmur.operators import filters as fl
from murmur.operators import growth, ingest, rolling, score, similarity, text
from murmur.operators.components import components
from murmur.operators.versions import latest
from murmur.sources import settings as S


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- version rule ------------------------------------------------------------


def test_latest_keeps_whole_rows(spark):
    t = [dt.datetime(2026, 1, d) for d in (1, 2)]
    df = spark.createDataFrame([("a", 1, "x", t[0]), ("a", None, "y", t[1]), ("a", None, "y", t[1]), ("b", 3, None, None), (None, 4, "z", t[0])], "id string, n int, s string, scraped_at timestamp")
    assert rows(latest(df, ["n", "s"])) == [("a", None, "y"), ("b", 3, None)]
    assert rows(latest(df.limit(0), ["n"])) == []


# --- trailing totals ---------------------------------------------------------


def test_trailing_totals_against_brute_force(spark):
    rng = np.random.default_rng(1)
    day0 = dt.date(2019, 12, 20)
    values = [("a" if k % 3 else None, day0 + dt.timedelta(int(d)), int(v)) for k, (d, v) in enumerate(zip(rng.integers(0, 1500, 300), rng.integers(-9, 10, 300)))] + [("a", None, 5), ("a", day0, None)]
    df = spark.createDataFrame(values, "e string, d date, v long")
    dates = [(e, day0 + dt.timedelta(int(k))) for e in ("a", None) for k in range(0, 1500, 7)]
    nodes = rolling.tree(df, ["e"], "d", "v", 365)
    out = rolling.trailing(nodes, spark.createDataFrame(dates, "e string, d date"), ["e"], "d", [1, 7, 30, 365]).collect()
    assert len(out) == len(dates)
    for r in out:
        for n in (1, 7, 30, 365):
            want = sum(v for e, d, v in values if e == r["e"] and d is not None and v is not None and r["d"] - dt.timedelta(n) < d <= r["d"])
            assert r[f"total_{n}"] == want
            assert r[f"average_{n}"] == pytest.approx(want / n)


def test_late_corrections_touch_ancestors_only(spark):
    d = [dt.date(1969, 12, 30), dt.date(1970, 1, 2), dt.date(1970, 1, 9)]
    df = spark.createDataFrame([("a", d[0], 1), ("a", d[1], 2)], "e string, d date, v long")
    nodes = rolling.tree(df, ["e"], "d", "v", 7)
    change = spark.createDataFrame([("a", d[1], 10), ("a", d[2], 4)], "e string, d date, v long")
    fixed = rolling.correct(nodes, change, ["e"], "d", "v", 7)
    again = rolling.tree(spark.createDataFrame([("a", d[0], 1), ("a", d[1], 12), ("a", d[2], 4)], "e string, d date, v long"), ["e"], "d", "v", 7)
    assert rows(fixed.drop("days")) == rows(again.drop("days"))
    assert rolling.tree(df.limit(0), ["e"], "d", "v", 7).count() == 0


@pytest.mark.parametrize("length", [1, 2, 3, 7, 8, 30, 365])
def test_cover_is_exact(length):
    top = rolling._levels(length)
    for r in range(1 << top):
        days = sorted(x for level, node in rolling._blocks(r, length, top) for x in range(node << level, (node + 1) << level))
        assert days == list(range(r - length + 1, r + 1))


# --- components --------------------------------------------------------------


def test_components_against_union_find(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5000), (None, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = dict(rows(components(spark.createDataFrame(edges, "x long, y long"), "x", "y")))
    assert got == {n: find(n) for n in parent}
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


# --- filters -----------------------------------------------------------------


def test_filter_parser_is_lenient_and_tells():
    f = fl.parse({"platform": "twitter,myspace", "minLikes": "x", "minXFactor": "0", "page": "0", "pageSize": "1000", "sort": "relevance", "dateFrom": "2026-01-01"})
    assert (f.platforms, f.min_likes, f.min_x_factor, f.page, f.page_size, f.timeframe) == (("twitter",), None, 0.0, 1, 200, "custom")
    assert len(fl.warnings(f)) == 3
    assert fl.parse({"platforms": ",".join(S.PLATFORMS)}).platforms == ()
    assert fl.narrows(f) and not fl.narrows(fl.parse({"q": "a", "sort": "likes", "page": "3"}))


def test_date_without_time_ends_before_the_day(spark):
    df = spark.createDataFrame([("a", dt.datetime(2026, 4, 14, 23)), ("b", dt.datetime(2026, 4, 15)), ("c", None)], "id string, posted_at timestamp")
    assert rows(df.where(fl.predicate(fl.parse({"dateTo": "2026-04-15"}), 0)).select("id")) == [("a",)]


def test_language_gate(spark):
    df = spark.createDataFrame([("plain",), ("привет",), ("abcdefg где",), ("123",), (None,)], "t string")
    assert [r[0] for r in df.select(fl.mostly_latin(F.col("t"))).collect()] == [True, False, True, True, True]


# --- scores ------------------------------------------------------------------


def _history(values, ages=10):
    day = S.DAY_MS
    return [(f"p{k:03d}", "a", v, (100 + k) * day, (100 + k + ages) * day) for k, v in enumerate(values)]


def test_score_of_a_known_history(spark):
    data = _history([100] * 8 + [1000] * 10) + [("t", "a", 5000, 118 * S.DAY_MS, 123 * S.DAY_MS)]
    df = spark.createDataFrame(data, "id string, author_id string, ws long, posted long, measured long")
    t = score.scores(df).where("id = 't'").first()
    spread = 1.4826 * (np.log(1001) - np.log(101)) / 4
    assert t["creator_baseline"] == pytest.approx(1000)
    assert t["creator_spread"] == pytest.approx(spread)
    assert t["x_score"] == pytest.approx((np.log(5001) - np.log(1001)) / spread)
    assert t["x_factor"] == pytest.approx(5) and t["x_provisional"] == 0


def test_score_edges(spark):
    day = S.DAY_MS
    data = _history([10] * 20)
    data += [("young", "a", 9, 121 * day, 121 * day + 1000), ("undated", "a", 9, None, None), ("nobody", "", 9, 121 * day, 130 * day), ("three", "a", 9, 122 * day, 125 * day), ("less", "a", 9, 122 * day, 125 * day - 1)]
    out = {r["id"]: r for r in score.scores(spark.createDataFrame(data, "id string, author_id string, ws long, posted long, measured long")).collect()}
    assert (out["young"]["x_score"], out["young"]["x_provisional"]) == (None, 1)
    assert (out["undated"]["weighted_score"], out["undated"]["x_provisional"]) == (9, 0)
    assert "nobody" not in out
    assert (out["three"]["x_provisional"], out["less"]["x_provisional"]) == (0, 1)
    assert out["three"]["creator_spread"] == S.SPREAD_FLOOR
    assert out["p017"]["x_score"] is None and out["p018"]["x_score"] is not None


# --- growth ------------------------------------------------------------------


def test_follower_deltas_and_windows(spark):
    at = lambda m, d, h=6: dt.datetime(2026, m, d, h)
    df = spark.createDataFrame([("a", at(9, 1).date(), at(9, 1), 1000), ("a", at(9, 5).date(), at(9, 5), 1200), ("a", at(9, 8).date(), at(9, 8), 1300), ("a", at(9, 9).date(), at(9, 9), 1400), ("b", at(9, 9).date(), at(9, 9), 5)], "author_id string, captured_on date, captured_at timestamp, followers long")
    end = int(dt.datetime(2026, 9, 10, tzinfo=dt.UTC).timestamp() * 1000) - 1
    one, seven = (growth.window_growth(df, ["author_id"], n, end).collect() for n in (1, 7))
    assert [(r["gained"], str(r["baseline_on"])) for r in one] == [(100, "2026-09-08")]
    assert [(r["gained"], r["gap_days"], str(r["baseline_on"])) for r in seven] == [(400, 8, "2026-09-01")]
    d = growth.follower_deltas(df, ["author_id"]).orderBy("captured_on").first()
    assert (d["gained"], d["gap_days"], d["per_day"]) == (200, 4.0, 50.0)


def test_engagement_deltas(spark):
    at = [dt.datetime(2026, 1, d) for d in (1, 2, 3)]
    df = spark.createDataFrame([("p", at[0].date(), at[0], 0, 0, 0), ("p", at[1].date(), at[1], 10, 2, 1), ("p", at[2].date(), at[2], 0, 0, 0)], "post_id string, captured_on date, captured_at timestamp, likes long, comments long, shares long")
    got = [(r["gained"], r["weighted_gained"], r["pct_of_total"]) for r in growth.engagement_deltas(df).orderBy("captured_on").collect()]
    assert got == [(13, 21, 100.0), (-13, -21, None)]


# --- text and vectors --------------------------------------------------------


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("hiring", "hire"), ("hired", "hire"), ("relational", "relat"), ("conditional", "condit"), ("hopping", "hop"), ("agreed", "agre"), ("sky", "sky"), ("happy", "happi"), ("rate", "rate"), ("controll", "control"), ("adoption", "adopt"), ("über", "über")])
def test_stems(word, want):
    assert stem(word) == want


def test_search(spark):
    df = spark.createDataFrame([("a", "ops at work"), ("b", "stops loops tops"), ("c", "we are hiring now"), ("d", "cold, outbound! mail"), ("e", "outbound cold"), ("f", None), ("g", "")], "id string, content string")
    find = lambda *t, m="any": [r[0] for r in rows(text.matches(df, "id", "content", t, m))]
    assert find("ops") == ["a"]
    assert find("hire") == ["c"] and find("hired", "ops") == ["a", "c"]
    assert find("cold outbound") == ["d"]
    assert find("cold", "outbound", m="all") == ["d", "e"]
    assert find("?!", "") == []
    assert [r["id"] for r in text.ranked(df, "id", "content", ["outbound"]).orderBy("bm25").collect()] == ["e", "d"]


def test_stemmed_search_without_texts(spark):
    from murmur.plans.text import stemmed_search
    from tests.oracle import DATA

    texts = ["Renewals, renewed: the RENEWAL", "ship it", None, "", "oying", "shyness re-newing", "über shipments shipped ship", "a 3rd renewing ship"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "id long, content string")
    terms = ("renewals", "shipped it", "oying", "ÜBER")
    want = {}
    for k, x in enumerate(texts):
        have = [stem(w) for w in text._PY_WORD.findall((x or "").lower())]
        n = sum(any(have[o : o + len(p)] == p for o in range(len(have))) for p in text.phrases(terms))
        want |= {k: n} if n else {}
    assert want == {0: 1, 1: 1, 4: 1, 6: 1, 7: 1}
    small = text.condensed(df, "content", terms)
    for rows_ in (df, small):
        assert {r["id"]: r["phrases"] for r in text.matches(rows_, "id", "content", terms).collect()} == want
    assert rows(text.ranked(small, "id", "content", terms)) == rows(text.ranked(df, "id", "content", terms)) != []
    # words are not put on disk beside Python, and no text is shuffled
    plan = stemmed_search(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "content#" in plan and "max_by" not in plan


def test_fusion(spark):
    rank = lambda *ids: spark.createDataFrame([(x, k + 1) for k, x in enumerate(ids)], "id string, rank int")
    assert [r["id"] for r in similarity.fused([rank("a", "b"), rank("b", "c")], "id").orderBy("place").collect()] == ["b", "a", "c"]
    assert similarity.fused([rank("a"), rank("a")], "id").first()["score"] == pytest.approx(2 / 61)


def _fan(*degrees):
    a = np.radians(degrees)
    x = np.stack([np.cos(a), np.sin(a)], 1)
    return x @ x.T


def test_three_ways_of_grouping():
    assert similarity.linked_groups(_fan(0, 30, 60), 0.8) == [[0, 1, 2]]
    assert sorted(similarity.greedy_clusters(_fan(0, 30, 50), 0.65)[0]) == [0, 1, 2]
    assert similarity.greedy_clusters(_fan(0, 44, 90), 0.65) == [[0, 1]]
    assert similarity.star_groups(_fan(0, 30, 60), 0.8) == [[0, 1]]


def test_blobs_and_usable_vectors():
    import pyarrow as pa

    assert from_blob(to_blob(np.array([1.5, -2]))).tolist() == [1.5, -2]
    with pytest.raises(ValueError):
        from_blob(b"abc")
    with pytest.raises(ValueError):
        to_blob(np.array([np.nan]))
    at, x = unpack(pa.array([[1, 0], None, [0, 0], [1], [float("nan"), 1], [None, 1], [0, 2]], pa.list_(pa.float32())), 2)
    assert at.tolist() == [0, 6] and x.tolist() == [[1, 0], [0, 2]]


# --- ingest ------------------------------------------------------------------


def test_merge_and_insert_ignore(spark):
    a = spark.createDataFrame([("a", 1), ("a", 2), ("", 3)], "id string, n int")
    b = spark.createDataFrame([("a", 4), ("b", 5)], "id string, n int")
    assert rows(ingest.merged_sources(a, b, "id", "n")) == [("a", 1, "both"), ("b", 5, "creator")]
    target = spark.createDataFrame([("x", "u1", 0)], "id string, url string, n int")
    batch = spark.createDataFrame([("x", "u9", 1), ("y", "u1", 2), ("z", None, 3), ("w", None, 4), ("v", "u2", 5), ("t", "u2", 6)], "id string, url string, n int")
    assert [r["id"] for r in ingest.insert_ignore(target, batch, "id", "url", "n").orderBy("id").collect()] == ["v", "w", "z"]


def test_keyed_writes(spark):
    t = spark.createDataFrame([("a", 1, "p"), ("b", 2, None)], "id string, n int, s string")
    n = spark.createDataFrame([("b", None, "q"), ("c", 3, None)], "id string, n int, s string")
    assert rows(ingest.upsert(t, n, ["id"], "n")) == [("a", 1, "p"), ("b", None, "q"), ("c", 3, None)]
    assert rows(ingest.upsert_coalesced(t, n, "id", ["n", "s"], "n")) == [("a", 1, "p"), ("b", 2, "q"), ("c", 3, None)]
    assert rows(ingest.update_only(t, n, "id", ["s"])) == [("a", 1, "p"), ("b", 2, "q")]
    assert rows(ingest.insert_missing(t, n, ["id"], "n")) == [("a", 1, "p"), ("b", 2, None), ("c", 3, None)]
    assert rows(ingest.delete(t, n, "id")) == [("a", 1, "p")]
    assert ingest.leaks(ingest.redacted(t, ["s"]), ["s"]) == 0 and ingest.leaks(t, ["s"]) == 1


def test_stream_with_watermark(spark, tmp_path):
    from murmur.streaming.capture import windowed

    spark.createDataFrame([("p", dt.datetime(2026, 1, d, h), v) for d, h, v in ((1, 1, 5), (1, 9, 7), (2, 1, 8), (9, 1, 9))], "post_id string, captured_at timestamp, likes int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("post_id string, captured_at timestamp, likes int").parquet(str(tmp_path / "in"))
    run = windowed(stream, ["post_id"], "captured_at").writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [(str(r["day"]), r["likes"]) for r in spark.table("closed").orderBy("day").collect()] == [("2026-01-01", 7), ("2026-01-02", 8)]


# --- composed calls -----------------------------------------------------------


def test_api_answers(spark):
    from murmur.plans.api import answer
    from tests.oracle import DATA

    plain = answer(spark, DATA, {"q": "pricing", "sort": "likes", "pageSize": "5"})
    assert plain.posts.count() <= 5 and plain.total.first()[0] >= plain.posts.count() and not plain.warnings
    fused = answer(spark, DATA, {"q": "pricing", "semantic": "true"}, embed=lambda q: [1.0] * 128)
    assert fused.posts.count() == 50 and fused.total.first()["total"] > 50

    def broken(q):
        raise OSError

    off = answer(spark, DATA, {"q": "pricing", "semantic": "true", "platform": "linkedin"}, embed=broken)
    assert off.warnings == ["semantic search is off: OSError"] and off.posts.count() > 0
    assert answer(spark, DATA, {"trends": "true", "semantic": "true"}).groups.count() >= 0
    assert answer(spark, DATA, {"q": "!!"}).posts.count() == 0


def test_ingest_batch(spark):
    import json

    from murmur.plans.batch import ingest as run

    raw = lambda *r: spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),) for x in r], "raw string")
    note = lambda n, body: {"type": "note", "id": n, "body": body, "url": f"https://l.example/{n}", "authorHandle": "h"}
    target = spark.createDataFrame([("substack-note-1", "https://l.example/1")], "id string, url string")
    got = run(target, {"substack": raw(note(1, "known"), note(2, "new"), note(2, "new"), note(3, "это по-русски"), "{")}, {"substack": raw(note(2, "new"), note(4, "other"))})
    assert [r["id"] for r in got.fresh.orderBy("id").collect()] == ["substack-note-2", "substack-note-4"]
    s = got.stats.first()
    assert (s["raw_keyword"], s["raw_creator"], s["merged"], s["found_in_both"], s["duplicates"], s["inserted"]) == (5, 2, 3, 1, 2, 2)
    assert [r["error"] for r in got.errors.collect()] == ["not JSON"] and got.authors.collect()[0][0] == "h"


def test_injected_functions(spark):
    from murmur.sources.injected import applied

    def length(texts):
        if "bad" in texts:
            raise TimeoutError
        return [None if t == "" else len(t) for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, ""), (3, None), (4, "bad")], "id long, t string").coalesce(1)
    got = {r["id"]: (r["value"], r["status"]) for r in applied(df, "id", "t", length, "long", size=2).collect()}
    assert got == {1: (3, "done"), 2: (None, "none"), 3: (None, "skipped"), 4: (None, "unavailable: TimeoutError")}


def test_landed_files(spark, tmp_path):
    from murmur.sources import landing

    (tmp_path / "log.jsonl").write_text('{"id": "a", "n": 1}\n{broken\n{"id": "b", "n": 2}\n')
    assert rows(landing.json_lines(spark, str(tmp_path / "log.jsonl"), "id string, n int")) == [("a", 1), ("b", 2)]
    (tmp_path / "c.csv").write_text('Profile,name\n"https://a.example",x\n\n  \nhttps://b.example\n')
    assert [r["cell"] for r in landing.first_cells(landing.csv_lines(spark, str(tmp_path / "c.csv"))).collect()] == ["https://a.example", "https://b.example"]
    assert landing.raw_records(spark, str(tmp_path / "log.jsonl")).count() == 3


def test_stored_tables_are_released(spark):
    from murmur.sources import shared

    df = shared.stored(spark.range(5), "numbers")
    path = df.inputFiles()[0].replace("file://", "")
    import os

    assert df.count() == 5 and os.path.exists(path)
    assert shared.release(spark) >= 1 and not os.path.exists(path) and shared.release(spark) == 0


def test_skew_join_equals_a_plain_join(spark):
    from murmur.operators.skew import skew_join

    many = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"k{i % 7}", i) for i in range(70)] + [(None, 1), ("alone", 2)], "k string, i int")
    few = spark.createDataFrame([("hot", 1), ("hot", 2), *[(f"k{i}", i) for i in range(6)], ("none", 1), (None, 3)], "k string, v int")
    counts = many.where("k IS NOT NULL").groupBy("k").count().withColumnRenamed("count", "n")
    plain = sorted(many.join(few, "k").collect())
    assert sorted(skew_join(many, few, ["k"], counts, least=100).select("k", "i", "v").collect()) == plain
    assert sorted(skew_join(many, few, ["k"], counts).select("k", "i", "v").collect()) == plain
    assert skew_join(many, few.limit(0), ["k"], counts, least=100).count() == 0


def test_clustered_sizes_partitions_from_the_scan(spark):
    from murmur.sources import tables

    posts = tables.table(spark, "/root/testdata/sf0.001", "posts")
    assert 50_000 < tables.scanned_bytes(posts.select("id", "embedding")) < 10_000_000
    assert tables.clustered(posts, "id").rdd.getNumPartitions() == 8
    assert tables.clustered(posts, "id", size=tables.TASK_BYTES * 20 - 1).rdd.getNumPartitions() == 20
    assert tables.clustered(spark.createDataFrame([(1,)], "id int"), "id").rdd.getNumPartitions() == 8


def test_parameters_of_reports():
    from murmur.operators import filters as fl

    assert [fl.window_days(x) for x in (None, "7", "30", "1.0")] == [1, 7, 30, 1]
    assert [fl.growth_days(x) for x in (None, "1", "365")] == [7, 1, 365] and fl.day_key(None) is None and fl.day_key("2026-06-30") == "2026-06-30"
    for f, bad in ((fl.window_days, ("2", "", "x")), (fl.growth_days, ("0", "366", "1.5", "nan", "")), (fl.day_key, ("2026-6-1", "today", ""))):
        for x in bad:
            with pytest.raises(ValueError):
                f(x)


def test_warnings_name_what_was_expected():
    from murmur.operators import filters as fl

    w = fl.warnings(fl.parse({"timeframe": "eon", "platform": "LinkedIn,myspace", "minLikes": "many", "imageThreshold": "high", "semantic": "true", "dateFrom": "2026-01-01"}))
    assert len(w) == 6 and any("expected one of" in x and "week" in x for x in w) and any("myspace" in x and "linkedin" in x for x in w)
    assert fl.parse({"platform": "LinkedIn"}).platforms == ("linkedin",)


def test_inputs_and_preferences():
    from murmur.sources import requests as r

    assert r.network_accounts(["u"], "3d") == {"targetUrls": ["u"], "maxPosts": 20, "postedLimit": "week"}
    assert r.micro_blog_keywords(["a"], favorites=0) == {"searchTerms": ["a"], "maxItems": 200, "sort": "Top", "minimumFavorites": 0}
    assert "userHandles" not in r.newsletter_accounts(["h"], "week") and r.newsletter_accounts(["h"], "week", notes=True)["maxNotesPerAuthor"] == 60
    assert r.photo_accounts(["x"], "all", "2026-01-01") == {"username": ["x"], "resultsLimit": 500, "onlyPostsNewerThan": "2026-01-01"}
    assert r.network_comments(["p"])["maxItems"] == 0 and r.network_keywords(["k"], "all")["postedLimit"] == "any" and r.newsletter_keywords(["k"], "24h", reactions=3)["minReactions"] == 3
    p = r.preferences('{"twitter": {"minimumFavorites": 12.9, "creators": "yes"}, "instagram": {"keywords": true}, "substack": {"includeNotes": true}, "linkedin": 3}')
    assert p["twitter"] == {"creators": True, "keywords": True, "timeframe": "week", "minimumFavorites": 12} and p["instagram"]["keywords"] is False and p["substack"]["includeNotes"] is True
    assert r.preferences("{broken") == r.preferences(None) == r.DEFAULT_PREFERENCES and "minimumFavorites" not in r.preferences('{"twitter": {"minimumFavorites": 0}}')["twitter"]
    assert [r.mode({"creators": a, "keywords": b}) for a in (True, False) for b in (True, False)] == ["both", "creator", "keyword", None]
    assert r.image_refused("file:///x") and r.image_refused("https://x", "text/html") and r.image_refused("https://x", "image/png", 9 << 20) and r.image_refused("https://x", "image/png; q=1", 10) is None


def test_ledger(spark):
    from murmur.operators import ledger as l

    at = dt.datetime(2026, 1, 1)
    runs = spark.createDataFrame([("a", "both", "x", at), ("b", "both", "x", at), ("c", "both", "x", at)], "id string, mode string, platforms string, started_at timestamp")
    done = spark.createDataFrame([("a", 5, 1, 4, 2, 1, 3, None, at), ("b", 5, 1, 4, 2, 1, 3, "boom", at), ("z", 1, 1, 1, 1, 1, 1, None, at)], f"id string, {', '.join(c + ' long' for c in l.COUNTS)}, error string, finished_at timestamp")
    got = {r["id"]: r for r in l.finished(l.started(runs), done).collect()}
    assert {k: v["status"] for k, v in got.items()} == {"a": "succeeded", "b": "failed", "c": "running"}
    assert got["a"]["inserted"] == 3 and got["b"]["inserted"] == 0 and got["b"]["error"] == "boom" and got["c"]["finished_at"] is None
    assert [r["id"] for r in l.recent(l.started(runs), 2).collect()] == ["c", "b"]
    assert l.masked({"k": "v", "s": ""}, ("s", "t")) == {"k": "v", "s": "unset", "t": "unset"} and l.ready({"k": "v"}, {"p": "k", "q": "z"}) == {"p": True, "q": False}


def test_drafts(spark, tmp_path):
    from murmur.operators import similarity as v
    from murmur.sources.landing import draft_files

    (tmp_path / "2026-05-01.json").write_text('{"drafts": [{"id": "a", "archetype": "story", "text": "t"}, {"id": 3, "archetype": "x", "text": "y"}, {"id": "b", "text": "t"}]}')
    (tmp_path / "2026-05-02.json").write_text("{broken")
    (tmp_path / "notes.json").write_text('{"drafts": [{"id": "z", "archetype": "s", "text": "t"}]}')
    got = draft_files(spark, str(tmp_path)).collect()
    assert [(str(r["day"]), r["draft"], r["archetype"], r["text"]) for r in got] == [("2026-05-01", "a", "story", "t")]
    day = dt.date
    posts = spark.createDataFrame([("p", day(2026, 5, 11), [1.0, 0.0]), ("q", day(2026, 5, 12), [1.0, 0.0]), ("r", day(2026, 5, 2), [0.0, 1.0])], "id string, day date, x array<float>")
    drafts = spark.createDataFrame([("a", day(2026, 5, 1), "s", [1.0, 0.1]), ("b", day(2026, 5, 1), "s", [1.0, 0.1]), ("n", day(2026, 5, 1), "s", None)], "draft string, day date, archetype string, y array<float>")
    assert [tuple(r) for r in v.draft_matches(posts, drafts, 2).collect()] == [("p", "a", "s", 0.995037)]


def test_drafts_of_busy_days(spark):
    from murmur.functions.dense import unit
    from murmur.operators import similarity as v

    rng = np.random.default_rng(5)
    n, dim, days = 1500, 8, 2
    x = rng.integers(-2, 3, (n, dim)).astype(np.float32)  # many equal similarities, some without a direction
    day = rng.integers(0, 5, n)
    frame = [(f"k{k:05d}", dt.date(2026, 5, 1) + dt.timedelta(int(day[k])), "ab"[k % 2], x[k].tolist()) for k in rng.permutation(n)]
    table = spark.createDataFrame(frame, "id string, day date, kind string, x array<float>").localCheckpoint()
    posts = table.select("id", "day", "x")
    drafts = table.selectExpr("id draft", "day", "kind archetype", "x y").unionByName(table.where("id < 'k00100'").selectExpr("id draft", "date_add(day, 1) day", "'0' archetype", "x y"))
    # no row a pair: 1.3 million of them
    assert v.draft_blocks(posts, drafts, days).count() <= 3 * n + 200
    got = {r["id"]: (r["draft"], r["archetype"], r["similarity"]) for r in v.draft_matches(posts, drafts, dim, days, 0.9).collect()}
    left = [(r["draft"], r["day"].toordinal(), r["archetype"], r["y"]) for r in drafts.collect()]
    left = [r for r in left if any(r[3])]
    y, of = unit(np.array([r[3] for r in left])), np.array([r[1] for r in left])
    want = {}
    for name, at, _, z in frame:
        if any(z):
            s = np.round(y @ unit(np.array([z]))[0], 6)
            near = [(-s[j], left[j][0], left[j][2]) for j in np.flatnonzero((of <= at.toordinal()) & (of >= at.toordinal() - days)) if left[j][0] != name]
            if near and -min(near)[0] >= 0.9:
                want[name] = (min(near)[1], min(near)[2], -min(near)[0])
    assert len(want) > 100 and got == want
    # the same from many small blocks
    sizes = v.BLOCK_POSTS, v.BLOCK_DRAFTS
    v.BLOCK_POSTS, v.BLOCK_DRAFTS = 160, 90
    try:
        assert {r["id"]: (r["draft"], r["archetype"], r["similarity"]) for r in v.draft_matches(posts, drafts, dim, days, 0.9).collect()} == want
    finally:
        v.BLOCK_POSTS, v.BLOCK_DRAFTS = sizes


def test_novelty_states(spark):
    from murmur.operators import similarity as v
    from murmur.sources.settings import DAY_MS, NOW_MS

    own = spark.createDataFrame([("o1", [1.0, 0.0]), ("o2", [1.0, 0.0]), ("o3", [0.0, 1.0])], "id string, x array<float>")
    asked = {"same": [1.0, 0.0], "near": [0.75, 0.66], "other": [0.66, 0.75], "far": [-1.0, -1.0]}
    history = spark.createDataFrame([("o1", NOW_MS - 40 * DAY_MS), ("o2", NOW_MS), ("o3", NOW_MS - 3 * DAY_MS)], "match string, posted_ms long")
    has = spark.createDataFrame([(k, True) for k in asked] + [("none", False)], "id string, has boolean")
    got = {r["id"]: (r["status"], r["match"], r["age_days"]) for r in v.novelty(v.best_matches(own, "id", "x", asked), has, history, NOW_MS).collect()}
    assert got == {"same": ("posted", "o1", None), "near": ("refresh_candidate", "o1", 40), "other": ("recently_covered", "o3", 3), "far": ("new", None, None), "none": ("unknown", None, None)}


def test_mapped_edges(spark):
    import json

    from murmur.operators import mappers as m

    raw = lambda *r: spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),) for x in r], "raw string")
    net = m.network_posts(raw({"id": "1", "linkedinUrl": "https://x/urn:li:activity:71/?a=1", "document": {"transcribedDocumentUrl": "d", "coverPages": [{"imageUrls": ["a", "b"]}]}}, {"id": "9", "repostedBy": {"name": "x"}, "postVideo": {"videoUrl": "v"}}, {"content": "lost"}, "{broken"), "ops").collect()
    assert [(r["id"], r["is_repost"], r["image_url"], r["market"], r["error"]) for r in net] == [("71", 0, "b", "ops", None), ("9", 1, None, "ops", None), (None, None, None, None, "no id"), (None, None, None, None, "not JSON")]
    assert json.loads(net[0]["media"]) == {"type": "document", "url": "d", "title": None, "pages": None, "cover": "b"} and json.loads(net[1]["media"])["poster"] is None
    news = m.newsletter_posts(raw({"type": "note", "kind": "restack", "id": 8, "authorHandle": "dee", "body": " ", "restackedPost": {"title": "Old"}}, {"type": "note", "id": 9}, {"type": "author", "id": 3}, {"slug": "how", "title": "How", "subtitle": "", "bodyMarkdown": "Body", "publicationHandle": "pub"})).collect()
    assert [(r["id"], r["content"], r["is_repost"], r["url"], r["author_url"], r["error"]) for r in news] == [
        ("substack-note-8", "Old", 1, "https://substack.com/@dee/note/c-8", "https://substack.com/@dee", None), (None, None, None, None, None, "empty note"), (None, None, None, None, None, "no content"),
        ("substack-how", "How\n\nBody", 0, None, "https://pub.substack.com", None),
    ]
    photo = m.photo_posts(raw({"shortCode": "C1", "type": "Video", "displayUrl": "p.jpg", "ownerUsername": "Ed"}, {"id": "33", "type": "Video", "videoUrl": "v", "displayUrl": "p"})).collect()
    assert [(r["id"], r["image_url"], json.loads(r["media"])["type"], r["url"]) for r in photo] == [("instagram-C1", "p.jpg", "image", "https://www.instagram.com/p/C1/"), ("instagram-33", "p", "video", None)]
    assert [(r["name"], r["followers"]) for r in m.profiles(raw({"publicIdentifier": "a", "firstName": "A", "lastName": "B", "name": "N"}, {"linkedinUrl": "https://l/in/bo/", "name": "Bo"})).collect()] == [("A B", 0), ("Bo", 0)]


def test_typed_accounts_and_urls(spark):
    from murmur.functions import scalars as sc

    x = F.col("x")
    said = {
        "https://www.linkedin.com/in/Ana-B/?x=1": ("linkedin", "Ana-B", "https://www.linkedin.com/in/Ana-B"), "linkedin.com/feed": ("linkedin", None, "linkedin.com/feed"), "@cy_1": ("twitter", "cy_1", "https://x.com/cy_1"), "cy_1": ("twitter", "cy_1", "https://x.com/cy_1"),
        "https://twitter.com/@cy_1/status/5": ("twitter", "cy_1", "https://x.com/cy_1"), "substack.com/@dee": ("substack", "dee", "https://substack.com/@dee"), "https://Dee.substack.com/p/1": ("substack", "dee", "https://dee.substack.com"), "https://open.substack.com/pub/x": (None, None, None),
        "instagram.com/@Ed.": ("instagram", "ed.", "https://www.instagram.com/ed./"), "https://www.instagram.com/s/abc": (None, None, None), "what is this": (None, None, None), "https://elsewhere.example/in/ana": (None, None, None),
    }
    rows = spark.createDataFrame([(k,) for k in said], "x string").select("x", *[c.alias(n) for n, c in sc.creator_input(x).items()]).collect()
    assert {r["x"]: (r["platform"], r["slug"], r["profile_url"]) for r in rows} == said
    urls = {"https://c/a?oe=6A000000": 1778384896, "https://c/a?e=1900000000": 1900000000, "https://c/a?oe=F&e=1900000000": None, "https://c/a?e=1900000000abc": None, "https://c/a?e=12": None, "https://c/a": None}
    assert {r["x"]: r["e"] for r in spark.createDataFrame([(k,) for k in urls], "x string").select("x", sc.expiry_seconds(x).alias("e")).collect()} == urls
    codes = {"https://instagram.com/p/C1-x/": "C1-x", "https://instagram.com/reels/C1/": None, "https://other.example/p/C1/": None}
    assert {r["x"]: r["c"] for r in spark.createDataFrame([(k,) for k in codes], "x string").select("x", sc.photo_shortcode(x).alias("c")).collect()} == codes


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    from murmur.streaming.capture import captured_table

    schema = "post_id string, captured_on date, captured_at timestamp, likes int"
    row = lambda p, d, h, n: (p, dt.date(2026, 1, d), dt.datetime(2026, 1, d, h), n)
    folder, root = tmp_path / "in" / "caps.parquet", f"file://{tmp_path}/table"
    args = (spark, str(tmp_path / "in"), "caps", ["post_id", "captured_on"], "captured_at", root, "captured_on")
    spark.createDataFrame([row("a", 1, 1, 1), row("a", 1, 5, 2), row("b", 2, 1, 3), (None, dt.date(2026, 1, 1), None, 9)], schema).coalesce(1).write.parquet(str(folder))
    assert sorted((r["post_id"], r["likes"]) for r in captured_table(*args).collect()) == [("a", 2), ("b", 3)]
    spark.createDataFrame([row("a", 1, 3, 7), row("b", 2, 9, 8), row("c", 3, 1, 4)], schema).coalesce(1).write.mode("append").parquet(str(folder))
    assert sorted((r["post_id"], r["likes"]) for r in captured_table(*args).collect()) == [("a", 2), ("b", 8), ("c", 4)]
    assert sorted((r["post_id"], r["likes"]) for r in captured_table(*args).collect()) == [("a", 2), ("b", 8), ("c", 4)]
    assert len([x for x in (tmp_path / "table").iterdir() if x.name[0] == "b"]) == 2


def test_greedy_clusters_against_a_plain_version():
    from murmur.operators.similarity import greedy_clusters

    rng = np.random.default_rng(3)
    for seed in range(8):
        x = rng.normal(size=(25, 3)) + 0.8
        u = x / np.linalg.norm(x, axis=1)[:, None]
        s = np.round(u @ u.T, 6)
        pairs = sorted(((-s[a, b], a, b) for a in range(25) for b in range(a + 1, 25) if s[a, b] >= 0.65))
        groups = []
        for _, a, b in pairs:
            ga, gb = ([g for g in groups if v in g] for v in (a, b))
            if not ga and not gb:
                groups.append([a, b])
            elif bool(ga) != bool(gb):
                g, new = (ga or gb)[0], b if ga else a
                to = [s[new, m] for m in g]
                if sum(to) / len(to) >= 0.65 and min(to) >= 0.6:
                    g.append(new)
        assert greedy_clusters(s, 0.65) == groups
