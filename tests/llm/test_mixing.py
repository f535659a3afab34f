from collections import Counter

from pyspark.sql import functions as F

from tapeloom.llm import mixing


def test_mix_targets(spark):
    rows = [(i, "w " * (5 if i < 90 else 300), "abc"[i % 3] if i < 90 else "z") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in got)
    want = {"a": 450.0, "b": 450.0, "c": 450.0, "z": total - 1350.0}  # capped at three times; z takes the rest
    for s, rs in by.items():
        assert abs(rs[0].target - want[s]) < 1e-6 and abs(sum(r.taken for r in rs) - want[s]) < 1
        assert all(0 <= r.taken <= 3 * r.size for r in rs)


def test_schedule_inversion(spark):
    knots = ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))
    shares = [i / 50 for i in range(51)]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in shares], "s double").select(mixing.invert_schedule(F.col("s"), knots)).collect()]
    for s, t in zip(shares, got, strict=True):
        assert abs((0.5 * t + t * t / 2) - s) < 1e-9  # the integral up to t, of a whole of 1


def words(n):
    return "w " * n


ODD = [(1, words(10), "a"), (1, words(10), "a"), (2, words(4), None), (3, None, "a"), (4, " \t\n", "b"), (None, words(7), "a"), (None, words(3), None), (5, words(60_000), "b"), (6, "one\u00a0word", "b"), (7, words(5), "")]


def odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    return docs.selectExpr("*", "1 as _taken", "2 as _position", "3 as size", "4 as _row", "5 as _order")


def test_odd_rows(spark):
    got = mixing.mix(odd_rows(spark)).collect()
    sizes = {"a": 27, "b": 60_001, "": 5, None: 7}  # sources in order: "", a, b, null
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter((d, n, sizes[s]) for (d, t, s), n in zip(ODD, (10, 10, 4, 0, 0, 7, 3, 60_000, 1, 5), strict=True))
    # all but the largest stop at three times their size, and it takes the rest
    total = sum(sizes.values())
    target = {"": 15.0, "a": 81.0, None: 21.0, "b": total - 117.0}
    for s, n in sizes.items():
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 for r in own) and sum(r.taken for r in own) == int(target[s] + 1e-9)
    assert all(0 <= r.taken <= 3 * r.size and (r.copies > 0) == (r.taken > 0) == (r.first_position is not None) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(odd_rows(spark).repartition(5)).collect()))
    assert mixing.mix(odd_rows(spark).limit(0)).collect() == []


def test_mixed_rows_are_whole_and_in_order(spark):
    docs = odd_rows(spark)
    out = mixing.mixed_documents(docs)
    rows = out.collect()
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text, r.source) for r in rows)
    want = Counter()
    for r, (d, t, s) in zip(sorted(mixing.mix(docs).collect(), key=lambda r: (str(r.doc_id), r.size, str(r.source))), sorted(ODD, key=lambda o: (str(o[0]), len((o[1] or "").split()) if o[0] != 6 else 1, str(o[2]))), strict=True):
        want[d, t, s] += r.copies
    assert got == +want
    assert mixing.mixed_documents(docs.limit(0)).collect() == []
    # a curriculum: the first source fades out, the third rises
    wide = spark.range(300).selectExpr("id as doc_id", "repeat('w ', 10) as text", "array('x', 'y', 'z')[cast(id % 3 as int)] as source")
    order = [r.source for r in mixing.mixed_documents(wide, weights=(1, 1, 1)).collect()]
    place = {s: sum(i for i, x in enumerate(order) if x == s) / order.count(s) for s in "xyz"}
    assert place["x"] < place["y"] < place["z"]


def test_a_word_count_by_hand(spark):
    texts = ["a b\tc\nd\x0be\x0cf\rg", "", None, "   ", "x" * 5000, "a\u2003b"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert {r.doc_id: r.size for r in mixing.mix(docs).collect()} == {0: 7, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1}
