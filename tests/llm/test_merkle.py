import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tapeloom.llm import merkle as M
from tests.oracle import compare


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def walk(levels, i):
    for level in levels[:-1]:
        first = i - i % 3
        yield level[first:i], level[i + 1 : first + 3]
        i //= 3


def plain(rows):
    """``rows``: doc_id, source, lang, n_chars, text -> the contract's columns."""
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append((r[0] is not None, r[0], leaf(r), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(sources[s], key=lambda x: (x[0], x[1] or 0, x[2]))]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for rank, s in enumerate(order):
        for i, (_, doc_id, own, r) in enumerate(sorted(sources[s], key=lambda x: (x[0], x[1] or 0, x[2]))):
            steps = [*walk(trees[s], i), *walk(top, rank)]
            text = r[4]
            if text is not None and zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf((*r[:4], text))
            for left, right in steps:
                folded = h("".join([*left, folded, *right]))
            root = top[-1][0]
            out.append((doc_id, own, trees[s][-1][0], root, h("".join(x for step in steps for side in step for x in side)), folded, folded == root))
    return out


key = lambda r: tuple((x is not None, x) for x in r)
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def check(spark, rows, tmp_path, extra=(), **sizes):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", *extra).write.mode("overwrite").parquet(path)
    got = M.op12_merkle(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)
    return got


def test_query(spark, sf):
    assert compare(spark, sf, M.op12_merkle, M.OP12_SQL) == 200
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted(map(tuple, M.op12_merkle(spark, sf).collect()), key=key) == sorted(plain(rows), key=key)


@pytest.mark.parametrize("levels,top", [(1, 4), (2, 5), (1, 1000), (7, 20_000)])
def test_blocks_of_any_size_and_tops_of_several_rounds(spark, levels, top):
    rng = random.Random(levels * top)
    rows = [(rng.randrange(2000), rng.choice(["a", "b", None, "hot", "hot", "hot", f"s{i % 37}"]), None, i, f"text {i % 90}\n") for i in range(700)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = M.manifest(docs, F.col("text"), levels, top).selectExpr("doc_id", "lower(hex(leaf))", "lower(hex(subroot))", "lower(hex(root))", "sha2(lower(hex(siblings)), 256)", "folded_root = root").collect()
    assert sorted(map(tuple, got), key=key) == sorted(((*r[:5], True) for r in plain(rows)), key=key)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_small_trees_fold_to_their_root(n):
    leaves = [bytes([i]) * 32 for i in range(n)]
    levels = M.levels_of(b"".join(leaves))
    assert [x.hex() for x in [levels[-1]]] == tree([x.hex() for x in leaves])[-1]
    for i, path in enumerate(M.paths(levels)):
        assert M.fold(leaves[i], path, [(i, n)]) == levels[-1]
        assert n == 1 or M.fold(b"\x77" * 32, path, [(i, n)]) != levels[-1]


def test_odd_rows(spark, tmp_path):
    rows = [
        (1, "b", None, 3, "x\ny"), (1, "b", None, 3, "x\ny"), (1, "b", None, 3, None), (None, None, None, None, None), (None, "a", "en", 0, ""),
        (2, "é", "de", 2, "\n\n"), (3, "z", "fr", 1, "日本\n\x00"), (4, "", "", -1, "a:b-"), (5, "a", "en", 9, "long\n" * 200_000), *([(7, "same", "en", 1, "s\n")] * 40),
    ]
    got = check(spark, rows, tmp_path, ["1 as pos", "2 as rank", "3 as digest", "4 as tree", "5 as block"])
    assert not all(r.verified for r in got) and any(r.verified for r in got)
    assert check(spark, rows[:1], tmp_path)[0].root == leaf(rows[0])
    assert check(spark, [], tmp_path) == []
