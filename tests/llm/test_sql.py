"""The training-data queries on the smallest tables: against their SQL, or against brute force where there is none."""

from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import regex

from murmur.llm import queries as q
from murmur.llm import vectors as V
from tests.oracle import DATA, connection, same

BRUTE = {"p1_found", "p2_found", "p2_classes", "p2_five_words", "p4_found", "p4_clusters", "p4_text_clusters", "p8_ids", "p9_found", "p9_mixture", "p9_shares", "p10_found", "p10_segments", "p10_languages"}


def test_every_query_is_tested():
    assert set(q.queries()) - set(q.oracle_sql()) == BRUTE


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_against_sql(spark, name):
    same(spark, q.queries()[name], q.oracle_sql()[name])


def rows(spark, name):
    got = [tuple(r) for r in q.queries()[name](spark, DATA).collect()]
    assert name.endswith("mixture") or len(got) == len(set(map(repr, got)))
    return got


@pytest.fixture(scope="module")
def posts():
    t = connection().sql(f"SELECT id, content, embedding, image_embedding FROM {q.LATEST}").to_arrow_table()
    return t.to_pydict()


def usable(column, ids, dim):
    keep = [k for k, x in enumerate(column) if x is not None and len(x) == dim and all(e is not None and np.isfinite(e) for e in x) and any(x)]
    return [ids[k] for k in keep], V.unit(np.array([column[k] for k in keep], np.float32))


def test_p1(spark, posts):
    want = set()
    for field, dim in q.VECTOR_FIELDS.items():
        ids, u = usable(posts[field], posts["id"], dim)
        s = np.round(u @ u.T, 6)
        np.fill_diagonal(s, -2)
        for i in range(len(ids)):
            best = sorted((-s[i, j], ids[j]) for j in np.flatnonzero(s[i] >= 0.8))[:10]
            want |= {(field, *sorted((ids[i], other))) for _, other in best}
    got = set(rows(spark, "p1_found"))
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def runs(posts, n, least):
    out = {}
    for i, t in zip(posts["id"], posts["content"]):
        w = regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
        if len(w) >= max(n, least):
            out[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    return out


def similar(sets, least):
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def test_p2(spark, posts):
    sets = runs(posts, 3, 30)
    want, got = similar(sets, 0.6), set(rows(spark, "p2_found"))
    assert got <= want and len(got) >= 0.99 * len(want)
    for name, held in (("p2_classes", sets), ("p2_five_words", runs(posts, 5, 0))):
        classes = {i: (c, n) for i, c, n in rows(spark, name)}
        assert set(classes) == set(held)
        linked = defaultdict(set)
        for a, b in similar(held, 0.6 if held is sets else 0.8):
            if classes[a][0] != classes[b][0]:
                linked[classes[a][0]].add(classes[b][0])
                linked[classes[b][0]].add(classes[a][0])
        wrong = sum(n != len(linked[c]) for c, n in classes.values())
        assert wrong <= 0.02 * len(classes)


def test_p4(spark, posts):
    from tests.llm.test_vectors import brute_clusters

    ids, u = usable(posts["embedding"], posts["id"], 128)
    vectors = dict(zip(ids, u))
    texts = {i: (t or "").strip() for i, t in zip(posts["id"], posts["content"])}
    long = {i: t for i, t in texts.items() if len(regex.findall(r"[\p{L}\p{N}]+", t.lower())) >= 30}
    donor = {}
    for i in sorted(ids):
        if i in long:
            donor.setdefault(long[i], vectors[i])
    for i, t in long.items():
        if i not in vectors and t in donor:
            vectors[i] = donor[t]
    want, got = brute_clusters(vectors), dict(rows(spark, "p4_found"))
    wanted = {i: c for i, c in want} if not isinstance(want, dict) else want
    assert sum(got.get(i) == c for i, c in wanted.items()) >= 0.98 * len(wanted) and len(set(got) - set(wanted)) <= 0.02 * len(wanted)
    sizes = Counter(got.values())
    for cluster, size, typical in ((r["cluster_id"], r["size"], r["typical"]) for r in q.queries()["p4_clusters"](spark, DATA).collect()):
        assert sizes[cluster] == size and len(typical) == 3 and all(got[i] == cluster for i in typical)
    for r in q.queries()["p4_text_clusters"](spark, DATA).collect():
        assert r["size"] >= 3 and len(r["typical"]) == 3


@pytest.fixture(scope="module")
def encoded():
    from tokenizers import Tokenizer

    from murmur.llm.encode import TOKENIZERS

    whole = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    whole.encode_special_tokens = True
    docs = duckdb.sql(f"SELECT doc_id, text, source FROM '{DATA}/documents.parquet'").fetchall()
    return {d: (whole.encode(t, add_special_tokens=False).ids if t else [], s) for d, t, s in docs}


def test_p8(spark, encoded):
    assert {d: list(ids) for d, ids in q.queries()["p8_ids"](spark, DATA).collect()} == {d: v[0] for d, v in encoded.items()}


def test_p9(spark, encoded):
    targets = {s.strip().lower(): (share, most) for s, share, most in duckdb.sql(f"SELECT source, target_share, max_repeats FROM '{DATA}/mix_targets.parquet'").fetchall()}
    size, total = Counter(), sum(len(i) for i, _ in encoded.values())
    for ids, s in encoded.values():
        if s is not None:
            size[s.strip().lower()] += len(ids)
    want = {s for s, (share, most) in targets.items() if size[s] * most < share * total}
    assert {s for (s,) in rows(spark, "p9_found")} == want
    used = Counter()
    for d, s, n, copy in rows(spark, "p9_mixture"):
        assert n == len(encoded[d][0]) and 1 <= copy <= targets[s][1]
        used[s] += n
    shares = {r["source"]: r for r in q.queries()["p9_shares"](spark, DATA).collect()}
    assert set(shares) == set(targets) and all(r["used"] == used[s] and r["capped"] == (s in want) for s, r in shares.items())
    assert sum(r["share"] for r in shares.values()) == pytest.approx(1, abs=1e-4)


def test_p10(spark):
    con = connection("/root/testdata/sf0.01")
    truth = {d: (lang, mixed) for d, lang, mixed in con.sql("SELECT doc_id, checked_lang, is_mixed FROM lang_samples").fetchall()}
    held = defaultdict(dict)
    for r in q.queries()["p10_languages"](spark, "/root/testdata/sf0.01").collect():
        held[r["doc_id"]][r["lang"]] = r["share"]
    right = sum(bool(held[d]) and max(held[d], key=held[d].get) == lang and (len(held[d]) > 1) == bool(mixed) for d, (lang, mixed) in truth.items())
    assert right >= 0.97 * len(truth)
    found = defaultdict(set)
    for d, lang in q.p10_found(spark, "/root/testdata/sf0.01").collect():
        found[d].add(lang)
    assert all(set(held[d]) == langs for d, langs in found.items())
    assert all(found[d] for d, langs in held.items() if len(langs) > 1)
    parts = q.p10_segments(spark, "/root/testdata/sf0.01").collect()
    assert {(r["doc_id"], r["lang"]) for r in parts} == {(d, x) for d, langs in held.items() for x in langs}
