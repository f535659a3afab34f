import hashlib
import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from tapeloom.llm import pieces as P

MODEL = P.default_model()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
CODER = P.Coder(MODEL)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def want(doc_id, text):
    ids = LIBRARY.encode(text or "")
    return doc_id, len(ids), digest(",".join(map(str, ids))), digest(LIBRARY.decode(ids)), True


def plain_ids(vocabulary, text):
    """The best pair of all neighbours, merged again and again."""
    symbols = list("▁" + text.replace(" ", "▁")) if text else []
    while True:
        pairs = [(vocabulary.costs[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in vocabulary.costs]
        if not pairs:
            break
        _, i = min(pairs)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return [x for s in symbols for x in ([vocabulary.ids[s]] if s in vocabulary.ids else [vocabulary.bytes[b] for b in s.encode()])]


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = P.op13_pieces(spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(want(*r) for r in rows)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeirstnlo ▁\n.,'-019éßñ日語😀\u0000"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text_is_encoded_like_the_library(text):
    ids, ends, agrees = CODER.encode([text, "", text])
    want = LIBRARY.encode(text)
    assert ids.tolist() == want + want and agrees and ends.tolist() == [0, len(want), len(want), 2 * len(want)]


def test_agenda_equals_repeated_best_pairs():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choices("aaab estring thhe.\n ", k=rng.randrange(30)))
        fragments = CODER.pattern.findall("▁" + text.replace(" ", "▁")) if text else []
        assert [x for f in fragments for x in CODER.vocabulary.encode(f)] == plain_ids(CODER.vocabulary, text) == LIBRARY.encode(text)
        for f in [*fragments, text]:
            assert CODER.vocabulary._merge_list(f) == CODER.vocabulary._merge_heap(f)


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(P, "CACHE_BYTES", 4000)
    coder = P.Coder(MODEL)
    for text in ["the same words again and again"] * 3 + ["some other words", "", "the same words"] * 5:
        ids, _, agrees = coder.encode([text])
        assert ids.tolist() == LIBRARY.encode(text) and agrees and len(coder) + len(coder.old) < 60


def test_check_replaces_what_differs():
    coder = P.Coder(MODEL)
    coder["▁odd"], coder.fresh = b"\x00\x00\x00\x00", ["▁odd"]
    ids, _, agrees = coder.encode(["odd"])
    assert ids.tolist() == LIBRARY.encode("odd") and not agrees


def test_other_models_are_refused(tmp_path):
    data = open(MODEL, "rb").read()
    path = tmp_path / "other.model"
    path.write_bytes(data.replace(b"\x18\x02 \x80\xfa\x01", b"\x18\x01 \x80\xfa\x01"))  # the kind of model
    with pytest.raises(ValueError):
        P.Vocabulary(str(path))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, " "), (3, "  a  b "), (4, "x" * 60_000 + " y"), (5, "▁ ▁"), (None, "日本\x00"), (6, "word " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as agrees", "3 as decoded", "4 as n_tokens")
    got = P.decode_documents(P.encode_documents(docs, MODEL), MODEL).collect()
    assert sorted(map(repr, P.encode_documents(docs, MODEL, decode=True).select(sorted(got[0].__fields__)).collect())) == sorted(repr(Row(**{c: r[c] for c in sorted(r.__fields__)})) for r in got)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, tuple(r.ids), r.decoded, r.agrees) for r in got), key=key) == sorted(((d, tuple(LIBRARY.encode(t or "")), LIBRARY.decode(LIBRARY.encode(t or "")), True) for d, t in rows), key=key)
    assert P.encode_documents(docs.limit(0), MODEL).collect() == []


def test_lists_of_any_size_are_decoded(spark, monkeypatch):
    rows = spark.createDataFrame([(1, None), (2, []), (3, LIBRARY.encode("a b  c"))], "decoded int, `odd ids` array<int>")
    got = P.decode_documents(rows, MODEL, "odd ids")
    assert got.columns == ["odd ids", "decoded"] and sorted(r.decoded for r in got.collect()) == ["", "", "a b  c"]
