from collections import Counter

import pytest

from tapeloom.llm import token_counts as T


def brute(lengths):
    n, total = len(lengths), sum(lengths)
    out = {}
    for x, c in Counter(lengths).items():
        over = [y for y in lengths if y >= x]
        out[x] = (c, c * x, len(over), sum(over), sum(y <= x for y in lengths), sum(y <= x for y in lengths) / n, sum(min(x, y) for y in lengths))
    assert total == sum(v[1] for v in out.values())
    return out


def rows(df):
    return {r.length: tuple(r)[1:] for r in df.collect()}


def test_query(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    enc = T.encoder(T.default_ranks())
    assert rows(T.op1_token_counts(spark, sf)) == brute([len(enc.encode_ordinary(t)) for t in texts])


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_answers_for_limits(spark, block):
    lengths = [0, 0, 5, 5, 5, 6, 7, 40, 41, 1000, 2500]
    hist = T.length_histogram(spark.createDataFrame([(x,) for x in lengths], "length long"), block)
    assert rows(hist) == brute(lengths)
    got = {r.context_limit: tuple(r)[1:] for r in T.totals_at(hist, [0, 5, 39, 41, 9999]).collect()}
    assert got == {m: (sum(x > m for x in lengths), sum(min(x, m) for x in lengths), sum(max(0, x - m) for x in lengths)) for m in (0, 5, 39, 41, 9999)}
    assert T.length_at_quantile(hist, 0.5) == 6 and T.length_at_quantile(hist, 1.0) == 2500


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, 1), ("", 2), ("a b", 3), ("a b", 3), ("<|endoftext|>", 4), ("long " * 50_000, 5)], "text string, length int")
    n = rows(T.count_tokens(docs, T.default_ranks()))
    assert n[0][0] == 2 and sum(v[0] for v in n.values()) == 6
    assert T.count_tokens(docs.limit(0), T.default_ranks()).collect() == []
