import numpy as np

from tapeloom.llm import shingle_sets as J


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_first(rows):
    sets, label = [(d, shingles(t)) for d, t in rows], {d: d for d, _ in rows}
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if (not x and not y) or (x & y and len(x & y) / len(x | y) >= 0.8)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return sorted(set(label.values()))


def edited_pairs(pairs=200, words=300):
    """Pairs of texts around a similarity of 0.8: some above, some below."""
    rng, rows = np.random.default_rng(5), []
    for k in range(pairs):
        w = [f"w{v}" for v in rng.integers(0, 50_000, words)]
        rows.append((2 * k, " ".join(w)))
        for i in rng.choice(words, rng.integers(4, 11), replace=False):
            w[i] = f"x{rng.integers(0, 50_000)}"
        rows.append((2 * k + 1, " ".join(w)))
    return rows


def test_pairs_at_the_limit_against_brute_force(spark):
    rows = edited_pairs()
    want = brute_first(rows)
    assert 240 < len(want) < 360
    got = sorted(r.doc_id for r in J.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == want


def test_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert sorted(r.doc_id for r in J.keep_first(docs).collect()) == brute_first([(r.doc_id, r.text) for r in docs.collect()])


def test_hot_block_in_tiles(spark):
    """Texts that share most of a boilerplate are one block; tiles give what one group gives."""
    rng, base = np.random.default_rng(6), [f"b{i}" for i in range(200)]
    rows = [(k, " ".join(base + [f"t{v}" for v in rng.integers(0, 10**6, 60)])) for k in range(60)]
    rows += [(100 + k, rows[k][1] + " and some more") for k in range(0, 60, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in J.keep_first(docs, tile_texts=10).collect())
    assert got == brute_first(rows) == list(range(60))


def test_tiles_compare_only_between_each_other():
    sets = [J.shingle_set(" ".join(f"w{i}" for i in range(k % 2, 200 + k % 2)).encode()) for k in range(4)]
    assert len(J.connecting_pairs(sets, np.zeros(4, int), 0.8)) == 3
    assert {tuple(sorted(p)) for p in J.connecting_pairs(sets[:2], np.array([0, 1]), 0.8)} == {(0, 1)}


def test_fingerprint_of_a_set():
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 300):
        x = rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + rng.integers(0, 2, n, np.uint64)
        want = sum(1 << b for b in range(64) if 2 * sum(int(v) >> b & 1 for v in x) > n)
        got = J.simhash_of(x) & (2**64 - 1)
        # bytes are read in the machine's order, bits of a byte from the top: one fixed order of bits
        assert bin(got).count("1") == bin(want).count("1")


def test_anchors_alone_propose_close_copies(spark):
    """Without bands, fingerprints within four bits and equal ones are proposed by op10's links."""
    rng = np.random.default_rng(4)
    values = rng.integers(-(2**62), 2**62, 40)
    rows = [(int(k), int(v), 9, []) for k, v in enumerate(values)] + [(100 + int(k), int(v ^ 0b1010011), 9, []) for k, v in enumerate(values)] + [(300, int(values[0]), 9, []), (400, 0, 0, []), (401, 0, 5, [])]
    classes = spark.createDataFrame(rows, "node long, fp long, n long, bands array<long>")
    got = {(r.a, r.b) for r in J.proposed_pairs(classes).collect()}
    assert {tuple(sorted(p)) for p in got} == {(k, 100 + k) for k in range(40)} | {(0, 300)}


def test_odd_rows(spark):
    text = "one two three four five six seven eight nine ten " * 20
    rows = [(1, text, "a"), (2, text.upper(), "a"), (2, text.upper(), "a"), (3, None, None), (4, "", "b"), (5, " \t", "b"), (None, text, "a"), (6, "short text", "a"), (7, "unlike all the others here", "a"),
            (7, "a second text under the same number", "a"), (None, "a text without a number", None), (None, "a text without a number", None), (None, None, "c"), (8, "same text and number", "z"), (8, "same text and number", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as h1", "2 as `row`", "3 as node", "4 as _first")
    kept = J.keep_first(docs)
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert kept.columns == docs.columns
    assert got == sorted([(1, text), (3, None), (6, "short text"), (7, "unlike all the others here"), (7, "a second text under the same number"), (None, "a text without a number"), (8, "same text and number")], key=str)
    one = [r.source for r in J.keep_first(docs).collect() if r.doc_id == 8]
    assert one == [r.source for r in J.keep_first(docs.orderBy("source")).collect() if r.doc_id == 8]  # not by chance
    assert J.keep_first(docs.limit(0)).collect() == []


def classes_of(spark, texts):
    rows = J.with_bands(J.keyed_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    return rows.where("n > 0").select("node", "n", "fp", "bands", "id")


def template_texts(n, shared, own, seed=9):
    rng, base = np.random.default_rng(seed), [f"b{i}" for i in range(shared)]
    return [" ".join(base + [f"t{v}" for v in rng.integers(0, 10**9, own)]) for _ in range(n)]


def test_texts_of_a_template_are_no_block(spark):
    """Texts two thirds of which are one template (similarity 0.49) share many buckets; sketches
    leave just the pairs that are alike."""
    texts = template_texts(1500, 100, 50)
    copies = [t + " and more" for t in texts[:40]]
    classes = J.staged(classes_of(spark, texts + copies), "template")
    firsts = J.bucket_firsts(classes).count()
    assert firsts > 1500  # the plain proposals connect most of them
    ids = {r.node: r.id for r in classes.collect()}
    got = {tuple(sorted((ids[r.a], ids[r.b]))) for r in J.alike_links(classes).collect()}
    assert got == {(k, 1500 + k) for k in range(40)}


def test_bucket_whose_first_is_unlike_the_others(spark):
    """All texts share a bucket; the first is like none, and tiles give what one group gives."""
    classes = classes_of(spark, ["one " * 9, *edited(12)])
    rows = [(r.node, r.n, 1000 * i, list(r.bands)) for i, r in enumerate(classes.collect())]
    key = min(rows)[3][0]
    rows = [(node, n, fp, [key, *bands[1:]]) for node, n, fp, bands in rows]
    one = J.staged(spark.createDataFrame(rows, "node long, n long, fp long, bands array<long>"), "one-bucket")
    for tile in (4_000, 5):
        links = J.alike_links(one, tile_sketches=tile).collect()
        reached = J.connected_components(spark.createDataFrame([(r.a, r.b) for r in links], "a long, b long")).count()
        assert reached == 12


def edited(n, words=400):
    """Texts that differ from each other in a word each."""
    base = [f"w{i}" for i in range(words)]
    return [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(40, 40 + 20 * n, 20)]


def test_sketches_keep_pairs_at_the_limit(spark):
    rows = edited_pairs()
    classes = J.staged(classes_of(spark, [t for _, t in rows]), "limit")
    node = {r.id: r.node for r in classes.collect()}
    pairs = spark.createDataFrame([(node[2 * k], node[2 * k + 1]) for k in range(200)], "a long, b long")
    alike = {(r.a, r.b) for r in J.judged_pairs(pairs, classes, 0.8).collect() if r.alike}
    sets = [shingles(t) for _, t in rows]
    near = [k for k in range(200) if len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) >= 0.8]
    assert near and all((node[2 * k], node[2 * k + 1]) in alike for k in near)


def test_sketch_links_against_all_pairs():
    rng = np.random.default_rng(12)
    base = rng.integers(0, 256, (6, J.BANDS * J.ROWS), np.uint8)
    s = base[rng.integers(0, 6, 90)].copy()
    s[rng.random(s.shape) < 0.13] = 7
    n, zero = rng.integers(80, 120, 90), np.zeros(90, np.int64)
    need = J.least_agreeing(0.8)
    fits = np.minimum(n[:, None], n) >= 0.8 * np.maximum(n[:, None], n) - 1e-6
    pairs = np.argwhere(((s[:, None] == s).sum(2) >= need) & fits)
    want = smallest_reached(90, pairs)
    assert 6 <= len(set(want)) < 90
    assert smallest_reached(90, J.connecting_sketches(s, n, zero, 0.8)) == want
    tiles = np.arange(90) % 3
    parts = [J.connecting_sketches(s[o], n[o], tiles[o], 0.8) for o in (np.flatnonzero((tiles == a) | (tiles == b)) for a in range(3) for b in range(a, 3))]
    owners = [np.flatnonzero((tiles == a) | (tiles == b)) for a in range(3) for b in range(a, 3)]
    assert smallest_reached(90, [(o[i], o[j]) for o, part in zip(owners, parts, strict=True) for i, j in part]) == want


def smallest_reached(n, pairs):
    root = list(range(n))
    for _ in range(n):
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    return root
