"""Encoding, mixing and languages on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.llm import encode, langid, mixing

#: Columns whose names clash with those used inside.
CLASH = {"d": 1, "x": "y", "o": 2, "h": 3, "k": 4, "l": 5, "ids": 6}


def samples():
    rng = np.random.default_rng(0)
    alphabet = list("abc  \n\t'.,!0189éßñ日本語のです。🚀‍  ​") + ["'s", " the", "don't", "   ", "<|endoftext|>", "й", "é"]
    out = ["".join(rng.choice(alphabet, int(rng.integers(0, 400)))) for _ in range(150)]
    shared = "It took 57 attempts to make the layout page less stubborn. Last year I would have called the layout playbook fragile, and I was wrong. "
    out += [shared * 3 + t for t in out[:20]] + ["問題は海外の採用面接ではなく、支援部のお知らせでした。" * 40, "a" * 5000, " " * 300 + "x", "x" + " " * 300, "word " * 20_000, "", " ", "\n\n", "é" * 300]
    return out


def test_ids_equal_encoding_whole(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    whole.encode_special_tokens = True
    texts = samples() + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).withColumns({n: F.lit(x) for n, x in CLASH.items()})
    got = {r["doc_id"]: r["ids"] for r in encode.corpus_ids(df, "doc_id", "text").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == (whole.encode(t, add_special_tokens=False).ids if t else []), repr(t[:80] if t else t)
    counts = {r["doc_id"]: r["tokens"] for r in encode.token_counts(df, ["doc_id"], "text").collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    assert encode.corpus_ids(df.limit(0), "doc_id", "text").count() == 0


def test_any_cut_is_repaired():
    t, _ = encode.tokenizer()
    rng = np.random.default_rng(1)
    for text in samples()[:120]:
        if len(text) > 3:
            at = sorted(set(rng.integers(1, len(text), 6).tolist()))
            parts = [np.array(t.encode_ordinary(text[a:b]), np.int64) for a, b in zip([0, *at], [*at, len(text)])]
            assert encode.joined(parts).tolist() == t.encode_ordinary(text)


def test_cuts_depend_on_near_text_only():
    a, b = "".join(chr(97 + i * 7 % 26) + " " * (i % 5 == 0) for i in range(900)), "unrelated start "
    shifted = {c - len(b) for c in encode.cuts(b + a)}
    assert {c for c in encode.cuts(a) if c > 40} == {c for c in shifted if c > 40}


def test_mixture(spark):
    docs = [(k, s, n) for k, (s, n) in enumerate([(" Big ", 10), ("big", 20), ("BIG", 30)] * 200 + [("small", 5)] * 40 + [("other", 7)] * 10 + [(None, 3), ("", 2), ("big", 0)])]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long").repartition(4)
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.4, 3), ("gone", 0.1, 5)], "source string, target_share double, max_repeats int")
    p = {r["source"]: r for r in mixing.plan(df, "source", "tokens", targets).collect()}
    total = sum(n for *_, n in docs)
    assert p["big"]["total"] == total and p["gone"]["size"] == 0
    mix = mixing.mixture(df, "doc_id", "source", "tokens", targets).collect()
    assert mix == mixing.mixture(df, "doc_id", "source", "tokens", targets).collect()
    big = sum(r["tokens"] for r in mix if r["source"] == "big")
    assert big == pytest.approx(0.5 * total, rel=0.1)
    assert sum(r["tokens"] for r in mix if r["source"] == "small") == 40 * 5 * 3
    assert max(r["copy"] for r in mix if r["source"] == "big") <= 2 and not any(r["source"] == "other" for r in mix)
    assert mixing.mixture(df.limit(0), "doc_id", "source", "tokens", targets).count() == 0
    r = {x["source"]: x for x in mixing.report(df, "doc_id", "source", "tokens", targets).collect()}
    assert {s: x["capped"] for s, x in r.items()} == {"big": False, "small": True, "gone": True}
    assert r["gone"]["used"] == 0 and sum(x["share"] for x in r.values()) == pytest.approx(1, abs=1e-5)


def test_rates_of_many_sources_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"s{k % 30}" if k % 3 else "s0", 10) for k in range(900)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([(f"s{k}", 1 / 30, 4) for k in range(30)], "source string, target_share double, max_repeats int")
    sent = sorted(mixing.mixture(docs, "doc_id", "source", "tokens", targets).collect())
    from murmur.operators import skew

    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 5)
    monkeypatch.setattr(skew, "LEAST_ROWS", 50)
    assert sorted(mixing.mixture(docs, "doc_id", "source", "tokens", targets).collect()) == sent


@pytest.mark.parametrize("cap", [1, 3, 8])
def test_poisson_means(cap):
    for mean in (0.01, 0.5, 0.9 * cap):
        s = mixing.steps(mean, cap)
        assert s == sorted(s) and sum(1 - x for x in s) == pytest.approx(mean, abs=1e-6)
    assert mixing.steps(cap, cap) == [-1.0] * cap


SENTENCES = {
    "en": ["The quarterly report was late and nobody noticed it.", "We asked the new people what they think about the plan.", "There is a small gap between the plan and the result."],
    "de": ["Der Bericht war zu spät und niemand hat es gemerkt.", "Wir haben die neuen Leute gefragt, was sie davon halten.", "Zwischen dem Plan und dem Ergebnis liegt eine kleine Lücke."],
    "ru": ["Отчёт опоздал, и никто этого не заметил сегодня.", "Мы спросили новых людей, что они думают об этом плане."],
    "ja": ["報告書は遅れましたが、誰も気づきませんでした。", "新しい人たちに計画についてどう思うか聞きました。"],
}


def trained():
    return langid.labelled_text([(lang, " ".join(s), True) for lang, s in SENTENCES.items()] + [("en", SENTENCES["de"][0], False)])


def test_languages(spark):
    en, de, ru, ja = (SENTENCES[x] for x in ("en", "de", "ru", "ja"))
    docs = [
        (1, " ".join(en), "en-GB"), (2, " ".join(en), "de"), (3, en[0] + " " + de[1], "en"), (4, de[0], None), (5, de[0], "Deutsch"), (6, "https://go.example/x #team @ana 12 / 7", "en"), (7, None, None), (8, "", "xx"), (9, " \n", None),
        (10, ru[0] + " " + ja[0], "ru"), (11, ja[1], "jpn"), (12, en[0].upper() + " 🚀", "EN"), (13, " ".join(en) * 200, "eng"), (14, en[1] + " `der Bericht war zu spät`", "en"), (15, en[2], "sv"), (16, en[2], " "),
        (19, "𝗪𝗲 𝗮𝘀𝗸𝗲𝗱 𝘁𝗵𝗲 𝗻𝗲𝘄 𝗽𝗲𝗼𝗽𝗹𝗲 what they think.", "de"),
        (17, " ".join(en).replace(".", "") * 300, "en"), (18, "we asked the new people " * 20_000, "de"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3).withColumns({n: F.lit(x) for n, x in CLASH.items()})
    found = langid.classify(df, "doc_id", "text", "lang", trained())
    got = {(r["doc_id"], r["lang"]) for r in langid.wrong_labels(found, "doc_id").collect()}
    assert got == {(2, "en"), (3, "en"), (3, "de"), (4, "de"), (10, "ru"), (10, "ja"), (15, "en"), (16, "en"), (18, "en"), (19, "en")}
    assert all(0 <= r["confidence"] <= 1 for r in found.collect())
    assert langid.classify(df.limit(0), "doc_id", "text", "lang", trained()).count() == 0
    assert langid.classify(df, "doc_id", "text", "lang", {}).count() == 0


def test_wrong_labels_are_left_out_of_the_sample():
    assert SENTENCES["de"][0].lower().split()[1] not in trained()["en"]


def test_pieces_against_a_plain_parse():
    texts = {"en": "the cat sat on the mat", "de": "der hund saß auf der matte"}
    parser = langid.Parser(texts)
    for s in ("the mat sat", "der auf the", "zzz", "saß"):
        for k, lang in enumerate(parser.languages):
            count, piece = 0, ""
            for c in s:
                if piece + c in texts[lang]:
                    piece += c
                else:
                    count += 1
                    piece = c if c in texts[lang] else ""
            assert parser.pieces([s])[0, k] == pytest.approx((count + 1) / len(s))


def test_training_takes_checked_documents_first(spark):
    docs = spark.createDataFrame([(k, s, "en" if k % 2 else "German") for k, s in enumerate(SENTENCES["de"] + SENTENCES["en"])], "doc_id long, text string, lang string")
    checked = spark.createDataFrame([(0, "de", 0), (1, "de", 0), (2, "de", 0), (3, "en", 0), (4, "en", 0), (5, "en", 1)], "doc_id long, checked_lang string, is_mixed int")
    t = langid.train(docs, "doc_id", "text", "lang", checked)
    assert "quarterly" in t["en"] and "bericht" in t["de"]
    assert langid.train(docs.limit(0), "doc_id", "text", "lang") == {}
