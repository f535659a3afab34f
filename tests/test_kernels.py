import random
from types import SimpleNamespace

import numpy as np
import pytest

from tapeloom.operators import book as B
from tapeloom.operators.fold import BookStage, FeatureStage, OrderStage


def messages(rows):
    names = ["msg_type", "ref", "new_ref", "side", "shares", "price"]
    f = {n: [r[k] for r in rows] for k, n in enumerate(names)}
    return f | {"seq": list(range(len(rows))), "locate": [1] * len(rows), "ts_ns": [1000 * i for i in range(len(rows))]}


def fold(rows):
    out = OrderStage()(messages(rows))
    each = zip(*(out[c] for c in ("seq", "leg", "status", "side", "price", "qty")), strict=True)
    return [(n, leg, status, None if price is None else (side, price, qty)) for n, leg, status, side, price, qty in each]


def test_add_partial_and_cancel_to_zero():
    assert fold([("A", 1, None, "B", 10, 100), ("E", 1, None, None, 4, None), ("X", 1, None, None, 6, None)]) == [
        (0, 1, "ok", ("B", 100, 10)), (1, 1, "ok", ("B", 100, 6)), (2, 1, "ok", ("B", 100, 0))]


def test_rejected_reductions_change_nothing():
    assert fold([("A", 1, None, "S", 5, 100), ("X", 1, None, None, 9, None), ("X", 1, None, None, 5, None), ("X", 2, None, None, 1, None), ("D", 2, None, None, None, None), ("U", 2, 3, None, 1, 1)]) == [
        (0, 1, "ok", ("S", 100, 5)), (1, 1, "bad_reduce", None), (2, 1, "ok", ("S", 100, 0)), (3, 1, "unknown_ref", None), (4, 1, "unknown_ref", None), (5, 1, "unknown_ref", None)]


def test_replaces_keep_their_side_and_take_off_first():
    got = fold([("A", 1, None, "S", 5, 100), ("U", 1, 2, None, 7, 100), ("U", 2, 3, None, 1, 90), ("U", 3, 4, None, 2, 90), ("D", 4, None, None, None, None)])
    assert got == [(0, 1, "ok", ("S", 100, 5)), (1, 1, "ok", ("S", 100, 0)), (1, 2, "ok", ("S", 100, 7)), (2, 1, "ok", ("S", 100, 0)), (2, 2, "ok", ("S", 90, 1)),
                   (3, 1, "ok", ("S", 90, 0)), (3, 2, "ok", ("S", 90, 2)), (4, 1, "ok", ("S", 90, 0))]


def test_duplicate_reference_and_empty_add():
    assert fold([("A", 1, None, "B", 5, 100), ("A", 1, None, "B", 3, 90), ("D", 1, None, None, None, None), ("A", 2, None, "B", 0, 80)]) == [
        (0, 1, "ok", ("B", 100, 5)), (1, 1, "ok", ("B", 90, 3)), (2, 1, "ok", ("B", 90, 0)), (3, 1, "ok", ("B", 80, 0))]
    with pytest.raises(ValueError, match="neither B nor S"):
        fold([("A", 1, None, "Q", 5, 100)])


def test_trades_are_attributed_before_the_reduction():
    out = OrderStage()(messages([("A", 1, None, "S", 5, 100), ("E", 1, None, None, 9, None), ("C", 1, None, None, 2, None), ("A", 2, None, "B", 5, 90), ("E", 2, None, None, 1, None), ("E", 7, None, None, 1, None)]))
    assert out["trade"] == [None, 9, 2, None, -1, None]
    assert out["resting"] == [1, 1, 1, 2, 2, 2]


def test_book_stage_matches_a_plain_book():
    rng = random.Random(4)
    rows = [(rng.choice("BS"), 100 + rng.randint(0, 30), rng.choice([0, 0, 1, 5, 9])) for _ in range(1500)]
    f = dict(zip(("side", "price", "qty"), map(list, zip(*rows, strict=True)), strict=True))
    stage = BookStage()
    parts = [stage({n: v[s] for n, v in f.items()}) for s in (slice(0, 400), slice(400, None))]
    got = [SimpleNamespace(**dict(zip(p, r, strict=True))) for p in parts for r in zip(*p.values(), strict=True)]
    books = {"B": {}, "S": {}}
    for (side, price, qty), r in zip(rows, got, strict=True):
        own = books[side]
        ahead = sum(p > price for p in own) if side == "B" else sum(p < price for p in own)
        assert (r.found, r.rank, r.existed) == (len(own), ahead, price in own)
        if qty:
            own[price] = qty
        else:
            own.pop(price, None)
        bids, asks = sorted(books["B"], reverse=True), sorted(books["S"])
        assert (r.bid_px, r.ask_px, r.bid_levels, r.ask_levels) == (bids[:5], asks[:5], len(bids), len(asks))
        assert r.bid_qty == [books["B"][p] for p in bids[:5]] and r.ask_qty == [books["S"][p] for p in asks[:5]]


def test_clear_empties_the_book():
    got = BookStage()({"side": ["B", "S"], "price": [100, 101], "qty": [5, 5], "action": [None, "clear"]})
    assert got["bid_px"] == [[100], []] and got["ask_px"] == [[], [101]]


def test_features_match_the_recurrences():
    touch = [(100, 104), (101, 104), (102, 102), (99, 104)]
    rows = {"bid_px": [[b] for b, _ in touch], "ask_px": [[a] for _, a in touch], "trade": [None, 50, -20, None]}
    got = FeatureStage()(rows)
    fast = slow = move = None
    volume = rate = np.float32(0)
    before = None
    for i, (b, a) in enumerate(touch):
        t = rows["trade"][i]
        if t is not None:
            volume, rate = np.float32(volume + np.float32(t)), np.float32(rate + np.float32(1))
        volume, rate = np.float32(volume * np.float32(0.999)), np.float32(rate * np.float32(0.999))
        mid = b + (a - b) // 2
        x, d = np.float32(mid), np.float32(0 if before is None else abs(mid - before))
        up = lambda v, k, y: y if v is None else np.float32(v + np.float32(k) * np.float32(y - v))
        fast, slow, move, before = up(fast, 0.10, x), up(slow, 0.03, x), up(move, 0.01, d), mid
        assert got["trade_rate"][i] == rate and got["signed_vol"][i] == np.float32(volume / np.float32(1000))
        if a == b:
            assert got["mom_fast"][i] is None and got["realized_vol"][i] is None
        else:
            inverse = np.float32(1) / np.float32(a - b)
            assert got["mom_fast"][i] == np.float32(np.float32(fast - slow) * inverse) and got["realized_vol"][i] == np.float32(move * inverse)
    assert got["mom_fast"][0] == 0


def test_state_passes_between_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(i, 1 + i % 2, i * 1000, "x", "BS"[i // 2 % 2], 100 + (i * 7) % 5, i % 4) for i in range(60)]
        df = spark.createDataFrame(rows, B.LEVEL_COLUMNS)
        small = sorted(map(repr, B.level_features(df).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == sorted(map(repr, B.level_features(df).collect()))


def test_one_shuffle_for_the_whole_chain(spark, sf):
    from tapeloom.sources import feeds

    plan = B.level_features(feeds.level_updates(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("MapInArrow") == 1


def test_halts_and_resumes(spark):
    ups = spark.createDataFrame([(1, 1, 10, "x", "B", 105, 5), (3, 1, 2_000_000, "x", "S", 100, 5), (5, 1, 2_500_000, "x", "S", 101, 5), (7, 1, 9_000_000, "x", "S", 102, 1)], B.LEVEL_COLUMNS)
    states = spark.createDataFrame([(2, 1, 1000, "H"), (4, 1, 2_400_000, "T")], "seq long, locate long, ts_ns long, state string")
    r = B.crossing_report(B.state_as_of(B.crossings(B.books(ups)), states)).first()
    assert (r.crossings, r.while_halted, r.near_resume, r.worst) == (3, 1, 1, 5)
