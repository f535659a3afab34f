import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from tapeloom.llm import quality as Q


def test_units():
    assert Q.units("This***") == ["this", "~***", "=x**"]
    assert Q.units("THE!!") == ["the", "~!!", "=X!!"]
    assert Q.units("|") == ["~|", "=|"]
    assert Q.units("River") == ["river", "=x"] and Q.units("12") == ["12", "=0"] and Q.units("USA") == ["usa", "=X"] and Q.units("I") == ["i", "=x"]


def test_units_by_the_plain_rule():
    """Words of one run, with signs behind it or not, take a shorter way to the same units."""

    def plain(word):
        parts = Q._PARTS.findall(word)
        kind = lambda p: "0" if p.isdigit() else "X" if p.isupper() and len(p) > 1 else "x"
        run = lambda p: p[0].isalnum() or p[0] == "_"
        return [p.lower() if run(p) else "~" + p[:4] for p in parts] + ["=" + "".join(kind(p) if run(p) else p[:2] for p in parts)[:8]]

    words = "a I USA 12 ²½ a_b _ __! a_. A_B! x. x… x.… .x don't e.g. (x) -12.5% ÉTÉ!!! ΣΑΣ. ΣΑΣ ΣΑ.ΣΑ straße, İx! 12, AB### ~~~~~ = =x == x=y=z=w+u-v ٣٤؟ 漢字。 a\u0301. \u0301 x\u200b. 👍 a👍!".split()
    assert [Q.units(w) for w in words] == [plain(w) for w in words]


def test_encoded_words_are_those_of_split():
    texts = [None, "", " ", "a b  a", "\u3000a\x1cb\x85 c\u2028", "c " * 50, "\n", "ab"] * 3
    for kind in (pa.string(), pa.large_string()):
        for chunk in (1, 30, 10_000):
            got = [[words[c] for c in part] for words, codes, counts in Q.encoded(pa.array(texts, kind).slice(1), chunk) for part in np.split(codes, np.cumsum(counts)[:-1])]
            assert got == [(t or "").split() for t in texts[1:]]
    assert list(Q.encoded(pa.array([], pa.string()))) == []


def test_each_word_is_looked_up_once(monkeypatch):
    """More distinct words than a cache of 100,000 held were taken apart at each of their places."""
    words, calls, units = ["".join(w) for w in product("abcdefghijklmnopqr", repeat=4)], [], Q.units
    monkeypatch.setattr(Q, "units", lambda word: calls.append(word) or units(word))
    got = Q.Pooler({"=x": 0}, np.ones((1, Q.DIMENSIONS), np.float32)).pool([" ".join(words)] * 3)
    assert len(calls) == len(words) == 104_976
    assert np.allclose(got[:, : Q.DIMENSIONS + 1], 1 / 2) and (got[:, -2] == 1).all() and (got[:, -3] == 0).all()


def test_neighbour_sums_of_frequent_and_rare_units():
    """Also where a text comes in parts, and pairs are counted in the table, beside it or not at all."""
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.2, 20_000) - 2, 499).astype(np.int32)  # -1 to 499
    base = rng.integers(-1, 2, (500, Q.DIMENSIONS)).astype(np.int32)
    want, got = np.zeros(base.shape, np.int64), np.zeros(base.shape, np.int64)
    for k in range(1, Q.WINDOW + 1):
        ok = (ids[:-k] >= 0) & (ids[k:] >= 0)
        np.add.at(want, ids[:-k][ok], base[ids[k:][ok]])
        np.add.at(want, ids[k:][ok], base[ids[:-k][ok]])
    for at in range(0, len(ids), 7000):
        seen = min(at, Q.WINDOW)
        Q.neighbour_sums(ids[at - seen : at + 7000], base, got, seen)
    assert (got == want).all()


def learned(spark, texts):
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    known = Q.vocabulary_of(docs)
    return known, Q.word_vectors(docs, known)


def test_word_vectors_follow_neighbours(spark):
    texts = ["red apple sweet", "red apple sweet", "red apple sweet", "green pear sweet", "green pear sweet", "green pear sweet", "bolt nut steel", "bolt nut steel", "bolt nut steel", None]
    known, v = learned(spark, texts)
    near = v[known["apple"]] @ v[known["pear"]]
    assert np.allclose(np.linalg.norm(v, axis=1), 1, atol=1e-5)
    assert near > v[known["apple"]] @ v[known["steel"]]


def test_vectors_against_plain_loops(spark, sf):
    """All texts of the table, one of them over the size at which sums are taken."""
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()][:60] + ["alpha beta, gamma delta. " * 90_000]
    known, v = learned(spark, texts)
    seen, want = {}, {}
    ids = [[known.get(u) for w in t.split() for u in Q.units(w)] for t in texts]
    for t in texts:
        for w in set(t.split()):
            for u in Q.units(w):
                seen[u] = seen.get(u, 0) + 1
    assert known == {u: i for i, u in enumerate(sorted((u for u, n in seen.items() if n > Q.LEAST_SEEN), key=lambda u: (-seen[u], u)))}
    base = np.array([Q.index_vector(u) for u in known], np.float64)
    pairs = {}
    for own in ids:
        for k in range(1, Q.WINDOW + 1):
            for a, b in zip(own, own[k:], strict=False):
                if a is not None and b is not None:
                    pairs[a, b] = pairs.get((a, b), 0) + 1
    want = base.copy()
    for (a, b), n in pairs.items():
        want[a] += n * base[b]
        want[b] += n * base[a]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(v, want, atol=1e-6)


def test_pooling_matches_a_plain_mean(spark):
    known, v = learned(spark, ["a b c d a b"] * 5)
    p = Q.Pooler(known, v)
    us = [u for w in "a b zzz a a".split() for u in Q.units(w)]
    want = sum(v[known[u]] for u in us if u in known) / len(us)
    got = p.pool(["x", "a b zzz a a", None, ""])[1]
    assert np.allclose(got[: Q.DIMENSIONS], want, atol=1e-5)
    assert np.isclose(got[-3], 1 / 5) and np.isclose(got[-2], 3 / 5)
    assert not p.pool(["", None]).any() and p.pool([]).shape == (0, Q.DIMENSIONS + 4)
    many = [" ".join(f"w{i % 7} a b{i}" for i in range(k)) for k in range(1, 60)]
    assert np.array_equal(p.pool(many), np.concatenate([p.pool([t]) for t in many]))


def test_temperature_lowers_loss():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 5))
    y = (x[:, 0] + rng.normal(size=800) > 0).astype(float)
    n = Q.Network().fit(x, y)
    z = (x - n.mean) / n.std
    own = n._loss(z, y)
    n.temperature = 0.25
    assert own < n._loss(z, y)


def test_query_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = Q.op3_quality(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in out) / len(out) > 0.97
    # scores are those that the model gives one text at a time
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = Q.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(abs(r.score - model.score([text[r.doc_id]])[0]) < 1e-9 for r in got[::50])


def test_odd_rows(spark):
    good, bad = "the quiet river runs past the old mill and on to the sea", "BUY!! NOW!! CHEAP!! CLICK!!"
    rows = [(i, (good if i % 2 else bad) + f" {i}") for i in range(200)] + [(500, None), (501, ""), (None, "text"), (7, good), (7, good), (502, "w " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as quality")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(7, 1), (None, 1), (300, None)], "doc_id long, quality int")
    m = Q.learn(docs, labels)
    got = Q.score_documents(docs, m).collect()
    assert len(got) == len(rows)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 200)
    kept = Q.keep_good(docs, m)
    assert kept.columns == docs.columns
    with pytest.warns(UserWarning, match="quality"):
        none = Q.learn(docs, labels.limit(0))
    assert {r.score for r in Q.score_documents(docs, none).collect()} == {1.0}
    assert Q.score_documents(docs.limit(0), m).collect() == []


def test_repeated_ids_and_labels_are_chosen_by_content(spark, sf):
    """The order and the partitions of rows decide nothing, also where ids repeat beyond the bound."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("doc_id", docs.doc_id % 40)
    labels = docs.selectExpr("doc_id", "cast(length(text) % 2 as int) quality")  # several labels an id
    learned = [Q.learn(d, k, fit_rows=30) for d, k in ((docs.repartition(5), labels.repartition(3)), (docs.orderBy("text"), labels.orderBy("quality")))]
    texts = [r.text for r in docs.limit(20).collect()]
    assert np.allclose(learned[0].score(texts), learned[1].score(texts))


def test_memory_of_neighbour_sums():
    """Vectors of all pairs of 150,000 units at once took over 200 MB."""
    import tracemalloc

    rng = np.random.default_rng(1)
    ids, base = rng.integers(0, 20_000, 150_000).astype(np.int32), rng.integers(-1, 2, (20_000, Q.DIMENSIONS)).astype(np.int32)
    sums = np.zeros(base.shape, np.int64)
    tracemalloc.start()
    Q.neighbour_sums(ids, base, sums)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.zeros(base.shape, np.int64)
    for k in range(1, Q.WINDOW + 1):
        np.add.at(want, ids[:-k], base[ids[k:]])
        np.add.at(want, ids[k:], base[ids[:-k]])
    assert (sums == want).all() and peak < 60e6


def test_one_kept_object_per_worker():
    from tapeloom.llm import common

    assert common.kept("a", lambda: [1]) is common.kept("a", lambda: [2])
    common.kept("b", lambda: [3])
    assert common.kept("a", lambda: [4]) == [4]
    common.release()
    assert not common._KEPT
