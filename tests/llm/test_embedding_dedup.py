import math

import numpy as np
import pytest

from tapeloom.llm import embedding_dedup as E


def brute(rows, threshold=0.95):
    usable = [i for i, (d, v) in enumerate(rows) if d is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = np.array([rows[i][1] for i in usable], np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x.reshape(0, 1)
    near = (x @ x.T >= threshold) if len(x) else np.zeros((0, 0), bool)
    near |= np.eye(len(x), dtype=bool)
    label = np.arange(len(x))
    while True:
        new = np.array([label[n].min() for n in near], int)
        if np.array_equal(new, label):
            break
        label = new
    out = {d: (0, d) for d, _ in rows}
    for k, i in enumerate(usable):
        out[rows[i][0]] = (int(near[k].sum()) - 1, min(rows[usable[m]][0] for m in np.flatnonzero(label == label[k])))
    return out


def clustered(n, dim, seed, clusters=6, per=40):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    for c in range(clusters):
        centre = rng.normal(size=dim)
        for k in range(per):
            base[(c * per + k) % n] = centre + rng.normal(size=dim) * rng.uniform(0, 0.35)
    return base.astype(np.float32).tolist()


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64))
    y = x + rng.normal(size=x.shape) * 0.4
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    codes, f = E.encode(x)
    rotated = y @ E.rotations(64, codes.shape[1]).T
    est = (codes * rotated).sum(1) / (16 * f)
    true = (x * y).sum(1)
    assert abs((est - true).mean()) < 0.005
    upper = np.array([E.upper_bounds(codes[i : i + 1], f[i : i + 1], rotated[i : i + 1])[0, 0] for i in range(len(x))])
    assert (upper >= true).mean() > 0.999
    assert (upper - true).mean() < 0.3


@pytest.mark.parametrize("tile", [2048, 16])
def test_against_brute_force(spark, tile):
    vectors = clustered(900, 32, tile)
    vectors[17] = vectors[3]
    vectors[18] = [2 * x for x in vectors[3]]
    rows = [(1000 - i, v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicate_vectors(df, miss=1e-5, tile=tile).collect()}
    want = brute(rows)
    assert sum(n for n, _ in want.values()) > 1000 and got == want


def test_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows)
    got = {r.vec_id: r for r in E.op5_embedding_dedup(spark, sf).collect()}
    links, found = sum(n for n, _ in want.values()), sum(r.n_links for r in got.values())
    assert all(got[d].n_links <= n for d, (n, _) in want.items()) and found >= 0.99 * links
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 0.0]), (9, [1.0, 0.1, 0.0]), (10, [1e-30, 0.0]), (11, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as h1", "3 as copies")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicate_vectors(df).collect()), key=str)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11)]
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (10, 3, 1, False), (None, 0, None, False), *alone], key=str)
    assert E.near_duplicate_vectors(df.limit(0)).collect() == []


def test_stored_codes_and_reruns(spark):
    rng = np.random.default_rng(2)
    codes, factors = E.encode(rng.normal(size=(50, 64)) / 8)
    assert np.array_equal(E.unpack_codes(E.pack_codes(codes)), codes) and len(E.pack_codes(codes)[0].as_py()) == 32
    rows = [(i, v) for i, v in enumerate(clustered(400, 24, 5))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    first, again = (sorted(map(tuple, E.near_duplicate_vectors(d, tile=64).collect())) for d in (df, df.repartition(7).orderBy("embedding")))
    assert first == again


def test_default_miss_against_brute_force(spark):
    rows = [(i, v) for i, v in enumerate(clustered(700, 48, 11))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    want = brute(rows)
    assert sum(n for n, _ in got.values()) >= 0.998 * sum(n for n, _ in want.values()) > 1000
    assert all(got[d][0] <= n for d, (n, _) in want.items())
