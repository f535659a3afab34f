import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeloom.llm import infilling as I
from tests.oracle import compare


def plain(doc_id, text, seed=1):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    hexes = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexes[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:i]), "".join(tokens[i:j]), "".join(tokens[j:])
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


key = lambda r: tuple((x is not None, x) for x in r)


def check(docs, rows):
    out = I.rearrange(docs)
    got = out.withColumn("back", I.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((plain(*r) for r in rows), key=key)
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)


def test_query(spark, sf):
    assert compare(spark, sf, I.op11_infilling, I.OP11_SQL) == 200
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    check(rows, [tuple(r) for r in rows.collect()])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=300), st.integers(0, 3))
def test_every_value_of_a_list_can_be_selected(gaps, scale):
    values = np.cumsum(np.array(gaps) // 100**scale)
    n, width, low, high = I.pack(values)
    assert n == len(values) and I.select(width, low, high, np.arange(n)).tolist() == values.tolist()
    assert len(low) + len(high) <= n * (3 + np.log2(max(1, values[-1] / n))) / 8 + 2


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abZz@[`{ \nŁß"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_borders_are_those_of_the_pattern(text):
    ends = np.cumsum([0, *map(len, re.findall("[A-Za-z]+|[^A-Za-z]", text))])
    assert I.borders(text).tolist() == ends.tolist()


ODD = [(1, None), (2, ""), (2, ""), (None, "null id"), (None, "null id"), (3, "has <P> in it"), (4, "<S"), (5, "S> <M"), (6, "é日本 😀\n\x00ab"), (7, "word " * 200_000), (8, "x" * 500_000), *((i, "ends with <") for i in range(9, 60))]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "1 as n", "2 as key", "3 as part", "4 as form", "5 as parts", "6 as _i")
    check(docs, ODD)
    assert I.rearrange(docs.limit(0)).collect() == []


def test_hot_texts_are_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(I, "HOT_ROWS", 7)
    rows = [(i if i % 3 else None, "one text of many copies" if i % 2 else f"text {i % 40}") for i in range(400)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_texts_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(I, "HOT_ROWS", 7)
    docs = spark.createDataFrame([(i, "one text of many copies" if i % 2 else f"text {i}") for i in range(400)], "doc_id long, text string")
    out = I.rearrange(docs)
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # the branches of hot and of other texts both read the index, and one of them made it
    reads = [x for x in final.splitlines() if "Exchange" in x and "first#" in x]
    made = [x for x in final.splitlines() if "SortAggregate" in x and "partial_first" in x]
    assert len(made) == 1 and any("ReusedExchange" in x for x in reads)
