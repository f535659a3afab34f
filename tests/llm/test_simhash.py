import numpy as np
import xxhash

from tapeloom.llm import simhash as S


def brute_fp(text, k=3):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))) if w]
    if not words:
        return 0
    parts = [" ".join(words)] if len(words) < k else [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    hs = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(items, max_bits=2):
    parent = list(range(len(items)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if bin(items[i][1] ^ items[j][1]).count("1") <= max_bits:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(items):
        if d is not None:
            r = find(i)
            least[r] = min(d, least.get(r, d))
    return sorted(((d, least.get(find(i))) for i, (d, _) in enumerate(items)), key=str)


def test_fingerprint_matches_brute_force():
    for t in [None, "", "  \t", "One", "One two", "ONE two three", "Éa b\x0bc d\x85e É f " * 40, "x " * 500, "a\x1cb c d e"]:
        assert S.fingerprint(None if t is None else t.encode()) == brute_fp(t), t


def test_golay_code_is_perfect_and_anchors_cover():
    patterns, starts = S.errors_within(3)
    assert len(patterns) == 2048 and (np.diff(starts) == 1).all()
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 300, dtype=np.int64)
    for bits in (1, 2):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(64, bits, replace=False):
                y[i] = np.int64(np.uint64(y[i].view(np.uint64)) ^ np.uint64(1 << int(b)))
        (ix, ax), (iy, ay) = S.anchors_of(x), S.anchors_of(y)
        for i in range(len(x)):
            assert set(ax[ix == i]) & set(ay[iy == i])


def test_large_groups_link_like_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    fp = np.unique(np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))) for _ in range(120)]))
    n = len(fp)
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2, 1))
    want = S.local_roots(n, i, j)
    for bits, got in ((2, S.links_within(fp, 2)),):
        assert np.array_equal(S.local_roots(n, *got), want), bits
    i3, j3 = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3, 1))
    assert np.array_equal(S.local_roots(n, *S.links_within(fp, 3)), S.local_roots(n, i3, j3))


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = S.op10_simhash(spark, sf).collect()
    rows = [(r.doc_id, brute_fp(r.text)) for r in docs.collect()]
    want = dict(rows)
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{v:016x}" for d, v in want.items()}
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == brute_components(rows)


def test_odd_rows(spark):
    rows = [(5, None, 1), (3, "", 2), (None, " ", 3), (9, "a b c d e", 4), (9, "a b c d e", 4), (8, "A b C d e", 5), (1, "zz", 6), (None, "only null id here", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int").withColumn("fp", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("x"))
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == brute_components([(d, brute_fp(t)) for d, t, _ in rows])
    assert S.near_duplicates(docs.limit(0)).collect() == []


def test_long_chain_is_one_component(spark):
    from tapeloom.llm.components import connected_components

    links = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {(r.node, r.root) for r in connected_components(links).collect()} == {(i, 0) for i in range(201)}


def test_half_of_the_threshold_finds_the_same_links(spark):
    rng = np.random.default_rng(9)
    fp = rng.integers(0, 2**64, 400, np.uint64)
    near = fp[:200].copy()
    for i in range(len(near)):
        for b in rng.choice(64, rng.integers(1, 4), replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    values = np.unique(np.concatenate((fp, near))).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in values], "fp long")

    def roots(spare):
        label = {v: v for v in values}
        links = [(r.a, r.b) for r in S.fingerprint_links(df, 2, spare).collect()]
        for _ in range(50):
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        return label

    whole = roots(None)
    assert whole == roots(2) == roots(1) and 100 < sum(k != v for k, v in whole.items())
    assert len(S.anchors_of(fp.view(np.int64), 2)[0]) > 4 * len(S.anchors_of(fp.view(np.int64), 1)[0])
    with __import__("pytest").raises(ValueError):
        S.fingerprint_links(df, 2, 0)
