import zlib
from collections import Counter

import numpy as np
import pytest

from tapeloom.llm import language as L


def brute_ngrams(text):
    out = Counter()
    clean = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = " " + " ".join(clean.split()) + " "
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            if g.strip() and not (n == 3 and g[1] == " "):
                out[g] += 1
    return out


def name(g):
    return "".join(chr(g >> s & 0x1FFFFF) for s in (42, 21, 0) if g >> s & 0x1FFFFF)


def test_ngrams_match_brute_force():
    for t in ["Ab, ab! éÉ\n\n x1y", "", "123 !!", "日本語 Ωμέγα", " lead and trail  "]:
        g, n = L.ngrams(t)
        assert {name(a): b for a, b in zip(g.tolist(), n.tolist())} == brute_ngrams(t) or not t.strip()


def test_profiles_rank_by_count_then_code_point():
    t = "the cat sat on the mat with the hat"
    want = sorted(brute_ngrams(t).items(), key=lambda x: (-x[1], tuple(map(ord, x[0].rjust(3, "\0")))))
    assert [name(g) for g in L.ranked(t, 20).tolist()] == [g for g, _ in want[:20]]


def test_out_of_place_distance():
    p = L.Profiles({"a": [10, 20, 30], "b": [30, 20, 10]}, k=3)
    own = np.array([10, 30, 40])
    orig = L.ranked
    try:
        L.ranked = lambda text, k: own
        lang, score = p.predict("x")
    finally:
        L.ranked = orig
    assert lang == "a" and abs(score - (1 - (0 + 1 + 3) / 9)) < 1e-12  # b: 2 + 1 + 3


def test_long_texts_and_words_across_blocks():
    rng = np.random.default_rng(1)
    words = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(1, 12, 4000)]
    text = " ".join(words[i] for i in rng.integers(0, 4000, 450_000))
    text = text[: L._BLOCK - 2] + "hello Σας" + text[L._BLOCK - 2 :]  # a word over the border
    assert len(text) > 2.5 * L._BLOCK
    g, n = L.ngrams(text)
    assert {name(a): b for a, b in zip(g.tolist(), n.tolist())} == brute_ngrams(text)
    one = "ab" * (L._BLOCK // 2 + 9)  # a single word longer than a block
    g, n = L.ngrams(one + " c")
    assert {name(a): b for a, b in zip(g.tolist(), n.tolist())} == brute_ngrams(one + " c")


def test_query_against_brute_force_predictor(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    profiles = {}
    for r in docs:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            profiles.setdefault(r.lang, Counter()).update(brute_ngrams(r.text or ""))
    order = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], tuple(map(ord, x[0].rjust(3, "\0")))))[: L.PROFILE]]
    profiles = {k: {g: i for i, g in enumerate(order(c))} for k, c in profiles.items()}
    want = {}
    for r in docs:
        own = order(brute_ngrams(r.text or ""))
        far = {k: sum(abs(p[g] - i) if g in p else L.PROFILE for i, g in enumerate(own)) for k, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        want[r.doc_id] = (best, 1 - far[best] / (len(own) * L.PROFILE)) if own else ("und", 0.0)
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.op6_language(spark, sf).collect()}
    assert got.keys() == want.keys()
    assert all(got[d][0] == w[0] and abs(got[d][1] - w[1]) < 1e-12 for d, w in want.items())


def test_no_language_is_left_out(spark):
    rows = [(i, f"{chr(0x4E00 + i // 2)}{chr(0x5E00 + i // 2)} " * 5, f"l{i // 2:03d}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 5}
    got = {r.doc_id: r.lang_pred for r in L.identify(docs, L.learn_profiles(docs)).collect()}
    assert len(known) > 220 and all(got[d] == lang for d, _, lang in rows if lang in known)
    with pytest.raises(ValueError):
        L.learn_profiles(docs, max_languages=100)


def test_query_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in L.op6_language(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    out = [r for r in docs if got[r.doc_id].held_out]
    assert {r.doc_id for r in out} == {r.doc_id for r in docs if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert sum(got[r.doc_id].lang_pred == r.lang for r in out) / len(out) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(spark):
    rows = [(1, "le chat et la souris " * 9, "fr"), (2, "the cat and the mouse " * 9, "en"), (3, None, "fr"), (None, "", None), (4, "1234 !!", "en"), (7, "the mouse", None), (7, "the mouse", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "0 as score", "'x' as lang_pred", "1 as __language")
    p = L.learn_profiles(docs)
    got = [(r.doc_id, r.lang_pred) for r in L.identify(docs, p).collect()]
    assert Counter(got) == Counter([(1, "fr"), (2, "en"), (3, "und"), (None, "und"), (4, "und"), (7, "en"), (7, "en")])
    kept = L.keep_identified(docs, p)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 7, 7]
    none = L.learn_profiles(docs.limit(0))
    assert L.identify(docs.limit(0), none).collect() == [] and {r.lang_pred for r in L.identify(docs, none).collect()} == {"und"}
