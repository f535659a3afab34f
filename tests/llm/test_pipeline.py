from collections import Counter

import corpus_pipeline as C
from tapeloom.llm import language, mixing, quality
from tapeloom.llm.common import staged
from tests.llm.test_packing import check
from tests.llm.test_shingle_sets import brute_first


def test_stages_against_brute_force(spark):
    from tokenizers import Tokenizer

    from tapeloom.llm import packing

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in C.STAGES[:-1]:
        seen.append(staged(stage(spark, seen[-1], sf), name))
        assert seen[-1].columns == columns
    rows = [{r.doc_id: r for r in d.collect()} for d in seen[:4]]
    # language: what identify() calls und, and nothing else, goes
    pred = {r.doc_id: r.lang_pred for r in language.identify(docs, language.learn_profiles(docs)).collect()}
    assert set(rows[1]) == {d for d, p in pred.items() if p != "und"} and len(rows[1]) == len(rows[0])
    # quality: labelled bad documents go, good ones stay
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    right = [(d in rows[2]) == bool(q) for d, q in labels.items() if d in rows[1]]
    assert sum(right) / len(right) > 0.97
    model = quality.learn(seen[1], spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(rows[2]) == {r.doc_id for r in quality.score_documents(seen[1], model).collect() if r.predicted}
    # near duplicates: one of each component
    assert sorted(rows[3]) == brute_first([(d, r.text) for d, r in rows[2].items()])
    assert len({r.text for r in rows[3].values()}) == len(rows[3])
    assert all(rows[3][d] == rows[2][d] for d in rows[3])
    # mixing: whole documents, as often as the mix takes them
    taken = {r.doc_id: r for r in mixing.mix(seen[3]).collect()}
    mixed = seen[4].collect()
    assert Counter(r.doc_id for r in mixed) == Counter({d: r.copies for d, r in taken.items() if r.copies})
    assert all(r == rows[3][r.doc_id] for r in mixed)
    # packing: the pieces of all copies
    got = C.STAGES[-1][1](spark, seen[4], sf).collect()
    check(got, [(r.doc_id, r.text) for r in mixed], Tokenizer.from_file(packing.default_tokenizer()), packing.CAPACITY)


def test_stages_with_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(1, "the quick brown fox and the lazy dog", "en", "a", 5), (2, None, None, None, None), (None, "some words here", "en", None, 3), (3, "", "fr", "a", 0), (4, "the quick brown fox and the lazy dog", "en", "b", 5), (4, "the quick brown fox and the lazy dog", "en", "b", 5), (5, "x " * 50_000, "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as fp", "'q' as position", "2 as score", "3 as _taken", "4 as _position", "5 as _row", "6 as __language")
    for name, stage in C.STAGES:
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, sf)
            got = out.collect()
            assert name == "pack" or out.columns == docs.columns
            assert len(got) == 0 or d is docs
        if name == "near_duplicates":
            assert sorted((r.doc_id for r in stage(spark, docs, sf).collect()), key=str) == [1, 2, 5, None]
        if name == "mix":  # 4 is there twice
            copies = Counter(r.doc_id for r in stage(spark, docs, sf).collect())
            assert None in copies and 2 not in copies and copies[4] == 2 * copies[1]
