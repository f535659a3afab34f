"""One symbol over many chunks gives what a fold in one go gives."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import book as B
from tapeloom.operators import chunks as C
from tapeloom.sources import feeds


def rows_of(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def updates(spark, sf):
    """Two symbols, one of which has nearly all rows."""
    return feeds.level_updates(spark, sf).withColumn("locate", F.when(F.col("seq") % 17 == 0, 2).otherwise(1).cast("long")).cache()


@pytest.fixture(scope="module")
def messages(spark):
    """Chains of replaces, references used twice, over-size reductions and unknown references."""
    rng, rows, live, ref = random.Random(6), [], [], 0
    for seq in range(1, 1500):
        kind = rng.choice("AAFEECXXDUUUP")
        own = rng.choice(live) if live and rng.random() < 0.9 else rng.randrange(-3, ref + 3)
        locate, new = (1 if own % 11 else 2), None
        if kind in "AF":
            ref += 1
            own = ref if rng.random() < 0.95 else own
            locate = 1 if own % 11 else 2
            live.append(own)
        elif kind == "U":
            ref += 1
            new = ref + (11 - (ref - own) % 11) % 11 if own % 11 == 0 else ref
            new = next(x for x in range(ref, ref + 30) if (x % 11 == 0) == (own % 11 == 0))
            ref = max(ref, new)
            live.append(new)
        if len(live) > 30:
            live.pop(rng.randrange(20))
        rows.append((seq, locate, (30_000 + 20 * seq) * 1_000_000_000, kind, own, new, rng.choice("BS"), rng.randrange(0, 9), 100 + rng.randrange(8)))
    return spark.createDataFrame(rows, "seq long, locate long, ts_ns long, msg_type string, ref long, new_ref long, side string, shares long, price long").cache()


@pytest.mark.parametrize("size", [7, 100, 900])
def test_books_over_chunks(updates, size):
    assert rows_of(B.books(updates, size)) == rows_of(B.books(updates))


@pytest.mark.parametrize("size", [5, 60])
def test_clears_between_chunks(updates, size):
    cleared = updates.withColumn("action", F.when(F.col("seq") % 97 == 0, "clear"))
    assert rows_of(B.books(cleared, size)) == rows_of(B.books(cleared))


def test_no_task_holds_a_hot_symbol(updates):
    dealt = C.with_carried(C.Chunks(updates, hot_rows=50).deal(updates))
    sizes = dealt.groupBy("locate", "chunk").count().collect()
    assert len(sizes) > 15 and max(r["count"] for r in sizes) < 250  # a chunk's rows and the levels it finds


@pytest.mark.parametrize("size", [40, 400])
def test_orders_by_life(messages, size):
    assert rows_of(B.order_fold(messages, size)) == rows_of(B.order_fold(messages))


def test_orders_of_a_derived_feed_by_life(spark, sf):
    messages = feeds.order_messages(spark, sf)
    assert rows_of(B.order_fold_by_life(messages, 30)) == rows_of(B.order_fold(messages))


def test_executions_go_by_the_orders_symbol(spark):
    rows = [(1, 1, 0, "A", 5, None, "S", 9, 100), (2, 7, 0, "E", 5, None, None, 4, None), (3, 7, 0, "E", 6, None, None, 4, None)]
    df = spark.createDataFrame(rows, "seq long, locate long, ts_ns long, msg_type string, ref long, new_ref long, side string, shares long, price long")
    got = {r.seq: (r.locate, r.status, r.trade, r.qty) for r in B.order_fold_by_life(df).collect()}
    assert got == {1: (1, "ok", None, 9), 2: (1, "ok", 4, 5), 3: (7, "unknown_ref", None, None)}


def test_order_books_over_chunks(messages):
    assert rows_of(B.order_books(messages, 90)) == rows_of(B.order_books(messages))


def close(a, b, names):
    """The folds of single precision lose up to half a unit of the price in each step, which
    adds up to that over the step's rate; chunks start from sums of double precision."""
    a, b = (df.orderBy(*[c for c in ("seq", "leg") if c in df.columns]).toPandas() for df in (a, b))
    exact = [c for c in a.columns if c not in names]
    assert a[exact].map(repr).equals(b[exact].map(repr))
    unit = np.spacing(np.float32(a.mid.max()))
    for n in names:
        x, y = a[n].astype(float), b[n].astype(float)
        assert (x.isna() == y.isna()).all(), n
        if n in ("signed_vol", "trade_rate"):
            assert np.allclose(x, y, rtol=1e-4, atol=1e-5, equal_nan=True), n
        else:
            assert x.notna().any() and ((x - y).abs() * a.spread.abs()).max() <= unit / 2 * (1 / 0.01 + 1 / 0.03) + unit, n


RECURRENT = ("mom_fast", "mom_slow", "signed_vol", "trade_rate", "realized_vol")


@pytest.mark.parametrize("size", [30, 300])
def test_features_over_chunks(updates, size):
    close(B.level_features(updates, size), B.level_features(updates), RECURRENT)


@pytest.mark.parametrize("gate", ["none", "hours"])
def test_order_features_over_chunks(messages, gate):
    close(B.order_features(messages, gate, hot_rows=110), B.order_features(messages, gate), RECURRENT)


def test_served_features_over_chunks(messages):
    states = messages.where("seq % 50 = 3").selectExpr("seq", "locate", "ts_ns", "if(seq % 100 = 3, 'H', 'T') as state")
    close(B.served_features(messages, states, 120), B.served_features(messages, states), RECURRENT)


def test_maps_compose_in_any_grouping():
    rng = np.random.default_rng(3)
    mids, kept = rng.integers(90, 110, 60).astype(float), rng.random(60) < 0.7
    trades, counts = rng.integers(-5, 5, 60).astype(float), (rng.random(60) < 0.4).astype(float)
    part = lambda a, b: C.summary(mids[a:b][kept[a:b]], kept[a:b], trades[a:b], counts[a:b])
    whole = C.compose(pd.DataFrame([part(0, 60)])).iloc[-1]
    for cuts in ([0, 1, 2, 3, 60], [0, 20, 20, 41, 60], [0, 59, 60]):
        got = C.compose(pd.DataFrame([part(a, b) for a, b in zip(cuts, cuts[1:])])).iloc[-1]
        assert np.allclose(got.astype(float), whole.astype(float))


@pytest.mark.parametrize("size", [9, 200])
def test_as_of_over_chunks(updates, size):
    states = updates.where("seq % 31 in (3, 7)").selectExpr("seq", "locate", "ts_ns", "if(seq % 2 = 0, 'H', 'T') as state")
    whole = B.state_as_of(updates, states)
    assert rows_of(B.state_as_of(updates, states, C.Chunks(updates, hot_rows=size))) == rows_of(whole)
    assert rows_of(B.books_with_states(updates, states, size)) == rows_of(B.books_with_states(updates, states))
    wanted = updates.select("locate", "seq", F.explode(F.array(F.lit("B"), F.lit("S"))).alias("side"), F.lit(999_900).cast("long").alias("price"))
    assert rows_of(B.qty_at(updates, wanted, size)) == rows_of(B.qty_at(updates, wanted))


@pytest.mark.parametrize("size", [3, 50, 10_000])
def test_running_sums_over_chunks(spark, size):
    df = spark.range(600).selectExpr("id % 3 div 2 as key", "id div 2 as at", "id % 2 as leg", "id % 7 - 3 as step")
    got = {(r["at"], r.leg, r.key): r.total for r in C.running(df, ["key"], ["at", "leg"], {"total": "step"}, size).collect()}
    totals = {0: 0, 1: 0}
    for i in range(600):
        key = i % 3 // 2
        totals[key] += i % 7 - 3
        assert got[i // 2, i % 2, key] == totals[key]


def test_gaps_over_ranges(spark):
    df = spark.createDataFrame([(i,) for i in (3, 4, 7, 8, 20, 21, 40)], "seq long")
    for width in (1, 5, 1000):
        assert sorted(map(tuple, B.missing(df, width=width).collect())) == [(5, 6), (9, 19), (22, 39)]


@pytest.mark.parametrize("size", [None, 4])
def test_stale_books_wait_for_their_snapshot(spark, size):
    row = lambda seq, locate, side, price, qty: (seq, locate, seq, "x", side, price, qty)
    ups = spark.createDataFrame([row(1, 1, "B", 10, 5), row(2, 2, "S", 30, 5), row(5, 1, "B", 11, 1), row(6, 2, "S", 31, 2), row(7, 1, "S", 12, 3), row(8, 2, "S", 29, 0)], B.LEVEL_COLUMNS)
    snaps = spark.createDataFrame([(4, 1, "B", 9, 7), (6, 2, None, None, None)], "seq long, locate long, side string, price long, qty long")
    got = {r.seq: (r.bid_px, r.ask_px) for r in B.resynced_books(ups, snaps, size).collect()}
    # symbol 1 is known again from the gap's end on, symbol 2 from 6 on, with an empty book before
    assert got == {1: ([10], []), 2: ([], [30]), 5: ([11, 9], []), 6: ([], [31]), 7: ([11, 9], [12]), 8: ([], [31])}


def test_levels_that_stand_in_many_snapshots(spark):
    """Given once, with the ordinals between which they stand, or in each snapshot: the same books,
    those of a replay. Feeds that clear their books themselves, too."""
    rng, rows, spans, every, books = random.Random(4), [], [], [], {}
    levels, began = {1: {}, 2: {}, 3: {}}, {}
    gap_ends = [-1, 9, 24, 26, 61, 75, 99]
    lost = {s for e in gap_ends for s in range(e - 3, e + 1)} - {26}
    for seq in range(140):
        locate, side, price = rng.choice([1, 1, 2]) if seq < 130 else 3, rng.choice("BS"), rng.randrange(10, 14)
        clear = rng.random() < 0.06
        qty = rng.choice([0, 5, 5, 9])
        for key in list(levels[locate]) if clear else [(side, price)]:
            if key in levels[locate]:
                spans.append((*began.pop((locate, *key)), seq - 1, locate, *key, levels[locate].pop(key)))
        if not clear and qty:
            levels[locate][side, price], began[locate, side, price] = qty, (seq,)
        rows.append((seq, locate, seq, "x", *((None, None, None) if clear else (side, price, qty)), "clear" if clear else None))
        books[seq] = tuple(sorted((p for s, p in levels[locate] if s == x), reverse=x == "B") for x in "BS")
        if seq in gap_ends:
            every += [(seq, own, *key, q) for own, held in levels.items() for key, q in held.items()] + [(seq, own, None, None, None) for own, held in levels.items() if not held]
    spans += [(*began[own, *key], None, own, *key, q) for own, held in levels.items() for key, q in held.items()]
    ups = spark.createDataFrame([r for r in rows if r[0] not in lost], B.LEVEL_COLUMNS + ", action string")
    at = spark.createDataFrame([(e,) for e in gap_ends], "seq long")
    once = spark.createDataFrame(spans, "seq long, until long, locate long, side string, price long, qty long")
    each = spark.createDataFrame(every, "seq long, locate long, side string, price long, qty long")
    want = {s: b for s, b in books.items() if s not in lost}
    for size in (None, 20):
        for got in (B.resynced_books(ups, once, size, at), B.resynced_books(ups, each, size)):
            assert {r.seq: (r.bid_px, r.ask_px) for r in got.collect()} == want


def test_resync_rows_grow_with_updates(spark, tmp_path, monkeypatch):
    """Not with symbols times gaps: 400 symbols and ten gaps here."""
    from tapeloom.plans.book_queries import book_resync

    events = spark.range(10_000).selectExpr("id as event_id", "timestamp_micros(id * 1000) as ts", "id % 400 as user_id", "'view' as event_type", "id * 1.0 as value", "concat('{\"k\": ', id % 7, '}') as props")
    events.where("event_id not between 4000 and 4020").write.parquet(f"{tmp_path}/events.parquet")  # ordinals that never were
    staged, sizes = B.staged, []

    def counted(df, name):
        out = staged(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(B, "staged", counted)
    monkeypatch.setattr(C, "staged", counted)
    assert book_resync(spark, str(tmp_path)).count() == 10_000 - 10 * 50 - 21
    assert max(sizes) < 3 * 10_000
