"""Ordered folds per symbol: the part of the work that is sequential by nature.

``symbol_fold`` deals rows by symbol once, sorts them by sequence and runs a chain of small
stateful stages over each symbol's rows. The chain shares that one shuffle, and state passes
from batch to batch, so a symbol's rows are never in memory together. Chunks of hot symbols are
keys of their own, whose first rows, without a sequence number, hold what came before them.

A stage takes the columns of consecutive rows of one symbol, as lists by name, and returns
columns. Batches hold many symbols, so what is paid per batch isn't paid per symbol.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from tapeloom.operators.chunks import summary

LEVELS = 5
Columns = dict[str, list]
Stage = Callable[[Columns], Columns]


def runs_of(keys: list[list]) -> Iterator[tuple[tuple, int, int]]:
    """(key, start, end) of each run of equal keys."""
    n, start = len(keys[0]), 0
    rows = list(zip(*keys, strict=True))
    for i in range(1, n + 1):
        if i == n or rows[i] != rows[start]:
            yield rows[start], start, i
            start = i


def symbol_fold(rows: DataFrame, stages: Sequence[Callable[[], Stage]], schema: str, key: str | Sequence[str] = "locate", order: str | Sequence[str] = "seq", dealt: bool = False) -> DataFrame:
    """``dealt`` says that all rows of a key are in one partition already."""
    keys = [key] if isinstance(key, str) else list(key)
    order = [order] if isinstance(order, str) else list(order)
    types = _parse_datatype_string(schema)
    assert isinstance(types, StructType)
    arrow = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, chain = None, []
        for b in batches:
            if not b.num_rows:
                continue
            columns = {n: c.to_pylist() for n, c in zip(b.schema.names, b.columns, strict=True)}
            out: Columns = {f.name: [] for f in arrow}
            for own, start, end in runs_of([columns[k] for k in keys]):
                if own != current:
                    current, chain = own, [make() for make in stages]
                part = {n: c[start:end] for n, c in columns.items()}
                for stage in chain:
                    part = stage(part)
                for name, values in out.items():
                    values.extend(part[name])
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    rows = rows if dealt else rows.repartition(*keys)
    return rows.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


class OrderStage:
    """Order messages to level updates with absolute quantities.

    Keeps orders by reference and totals by level. A message gives one row, a replace of a
    known order two; one that changes nothing gives a row without a price. ``status`` is ok,
    unknown_ref or bad_reduce. Adding a known reference overwrites the order and leaves its
    level as it is; reducing by more than an order has changes nothing; a replace of an
    unknown order adds nothing. ``trade`` is the signed size of an execution of a known order:
    positive if it rested on the sell side, also if the reduction is then rejected.
    """

    def __init__(self) -> None:
        self.orders: dict[int, list] = {}
        self.levels: dict[tuple[str, int], int] = {}

    def _level(self, side: str, price: int, change: int) -> tuple:
        total = max(0, self.levels.get((side, price), 0) + change)
        if total:
            self.levels[side, price] = total
        else:
            self.levels.pop((side, price), None)
        return side, price, total

    def _add(self, ref: int, side: str, price: int, shares: int) -> tuple:
        if side not in ("B", "S"):
            raise ValueError(f"side {side!r} of order {ref} is neither B nor S")
        self.orders[ref] = [price, shares, side]
        return self._level(side, price, shares)

    def _reduce(self, ref: int, shares: int | None) -> tuple[str, tuple | None]:
        order = self.orders.get(ref)
        if order is None:
            return "unknown_ref", None
        price, left, side = order
        shares = left if shares is None else shares
        if shares > left:
            return "bad_reduce", None
        order[1] -= shares
        if not order[1]:
            del self.orders[ref]
        return "ok", self._level(side, price, -shares)

    def __call__(self, f: Columns) -> Columns:
        rows = []
        columns = (f[c] for c in ("msg_type", "ref", "new_ref", "side", "shares", "price"))
        for i, (kind, ref, new_ref, side, shares, price) in enumerate(zip(*columns, strict=True)):
            trade, status, change = None, "ok", None
            if kind in "EC" and ref in self.orders:
                trade = shares if self.orders[ref][2] == "S" else -shares
            if kind in "AF":
                change = self._add(ref, side, price, shares)
            elif kind in "ECX":
                status, change = self._reduce(ref, shares)
            elif kind == "D":
                status, change = self._reduce(ref, None)
            elif kind == "U":
                held = self.orders.get(ref)
                rest = held and held[2]
                status, change = self._reduce(ref, None)
                if change is not None:
                    rows.append((i, 1, status, trade, False, *change, len(self.orders)))
                    rows.append((i, 2, status, trade, True, *self._add(new_ref, rest, price, shares), len(self.orders)))
                    continue
            else:
                continue
            rows.append((i, 1, status, trade, True, *(change or (None, None, None)), len(self.orders)))
        at = [r[0] for r in rows]
        out = {c: [values[i] for i in at] for c, values in f.items() if c in ("seq", "locate", "ts_ns", "msg_type", "state", "since")}
        for k, name in enumerate(("leg", "status", "trade", "last_leg", "side", "price", "qty", "resting"), 1):
            out[name] = [r[k] for r in rows]
        return out


ORDER_SCHEMA = "seq long, locate long, ts_ns long, msg_type string, leg int, status string, trade long, last_leg boolean, side string, price long, qty long, resting long"


class LifeStage:
    """Messages, sorted by the root of their order's life and then by sequence, to changes of
    levels. All that one order meets, through all references that replaces give it, is one life;
    it is worked through like by ``OrderStage``, but gives what a message adds to a level and to
    the number of resting orders in place of totals. Rows carry the order's symbol."""

    def __init__(self) -> None:
        self.root: int | None = None
        self.orders: dict[int, list] = {}

    def __call__(self, f: Columns) -> Columns:
        out: list[tuple] = []
        columns = (f[c] for c in ("root", "locate", "msg_type", "ref", "new_ref", "side", "shares", "price"))
        for i, (root, locate, kind, ref, new_ref, side, shares, price) in enumerate(zip(*columns, strict=True)):
            if root != self.root:
                self.root, self.orders = root, {}
            orders, opens = self.orders, kind in "AF"
            if opens:
                if side not in ("B", "S"):
                    raise ValueError(f"side {side!r} of order {ref} is neither B nor S")
                fresh = int(ref not in orders)
                orders[ref] = [price, shares, side, locate]
                out.append((i, locate, 1, "ok", None, True, side, price, shares, fresh))
                continue
            held = orders.get(ref)
            if held is None:
                out.append((i, locate, 1, "unknown_ref", None, True, None, None, None, 0))
                continue
            at, left, own, home = held
            trade = (shares if own == "S" else -shares) if kind in "EC" else None
            taken = left if kind in "DU" else shares
            if taken > left:
                out.append((i, home, 1, "bad_reduce", trade, True, None, None, None, 0))
                continue
            held[1] = left - taken
            gone = not held[1]
            if gone:
                del orders[ref]
            out.append((i, home, 1, "ok", trade, kind != "U", own, at, -taken, -int(gone)))
            if kind == "U":
                fresh = int(new_ref not in orders)
                orders[new_ref] = [price, shares, own, home]
                out.append((i, home, 2, "ok", trade, True, own, price, shares, fresh))
        at = [r[0] for r in out]
        names = ("locate", "leg", "status", "trade", "last_leg", "side", "price", "change", "born")
        kept = {c: [f[c][i] for i in at] for c in ("seq", "ts_ns", "msg_type", "state", "since") if c in f}
        return kept | dict(zip(names, map(list, zip(*[r[1:] for r in out], strict=True)) if out else ([] for _ in names), strict=True))


LIFE_SCHEMA = "seq long, locate long, ts_ns long, msg_type string, leg int, status string, trade long, last_leg boolean, side string, price long, change long, born long"


class BookStage:
    """Level updates to the book after each: both sides' best levels, and how deep the change
    lay in the side that it found. A row without a price leaves the book as it is; action
    ``clear`` empties it before a snapshot."""

    def __init__(self) -> None:
        self.qty: dict[str, dict[int, int]] = {"B": {}, "S": {}}
        self.keys: dict[str, list[int]] = {"B": [], "S": []}  # best first: bids by minus price
        self.best: dict[str, tuple[list[int], list[int]]] = {"B": ([], []), "S": ([], [])}  # prices, quantities; replaced, never changed

    def __call__(self, f: Columns) -> Columns:
        actions = f.get("action") or [None] * len(f["side"])
        out: list[tuple] = []
        for side, price, qty, action in zip(f["side"], f["price"], f["qty"], actions, strict=True):
            if action == "clear":
                self.__init__()
            found = rank = existed = None
            if price is not None:
                totals, keys = self.qty[side], self.keys[side]
                key = -price if side == "B" else price
                found, rank, existed = len(keys), bisect_left(keys, key), price in totals
                if qty:
                    if not existed:
                        insort(keys, key)
                    totals[price] = qty
                elif existed:
                    del totals[price], keys[rank]
                if rank < LEVELS:  # a change beyond them leaves the best levels as they are
                    top = [-x for x in keys[:LEVELS]] if side == "B" else keys[:LEVELS]
                    self.best[side] = top, [totals[p] for p in top]
            (bid_px, bid_qty), (ask_px, ask_qty) = self.best["B"], self.best["S"]
            out.append((bid_px, bid_qty, ask_px, ask_qty, len(self.keys["B"]), len(self.keys["S"]), found, rank, existed))
        names = ("bid_px", "bid_qty", "ask_px", "ask_qty", "bid_levels", "ask_levels", "found", "rank", "existed")
        return f | dict(zip(names, map(list, zip(*out, strict=True)) if out else ([] for _ in names), strict=True))


BOOK_COLUMNS = "bid_px array<long>, bid_qty array<long>, ask_px array<long>, ask_qty array<long>, bid_levels int, ask_levels int, found long, rank long, existed boolean"


class FeatureStage:
    """The recurrent features, in float32, over the rows that ``keep`` lets through: three
    averages of the middle price, decayed signed volume and trade count, and the average
    absolute move. Trades add up at every row; all else moves only with rows kept. Rows without
    a sequence number are not of the feed; one with a ``start`` gives the state to start from."""

    def __init__(self, keep: Callable[[Columns], list[bool]] | None = None):
        self.keep = keep
        self.fast = self.middle = self.slow = self.moves = self.before = None
        self.volume = self.rate = np.float32(0)

    def _start(self, state: list[float]) -> None:
        fast, middle, slow, moves, before, self.volume, self.rate = map(np.float32, state)
        if not np.isnan(before):
            self.fast, self.middle, self.slow, self.moves, self.before = fast, middle, slow, moves, int(state[4])

    def __call__(self, f: Columns) -> Columns:
        f32 = np.float32
        one, thousand, decay, quick, mild, calm = f32(1), f32(1000), f32(0.999), f32(0.10), f32(0.03), f32(0.01)
        n = len(f["bid_px"])
        trades, legs, lasts = f.get("trade") or [None] * n, f.get("leg") or [1] * n, f.get("last_leg") or [True] * n
        gate = self.keep(f) if self.keep else [True] * n
        starts = f.get("start")
        if starts is not None:
            gate = [ok and seq is not None for ok, seq in zip(gate, f["seq"], strict=True)]
        out: list[tuple] = []
        for bids, asks, trade, leg, last, open_, start in zip(f["bid_px"], f["ask_px"], trades, legs, lasts, gate, starts or [None] * n, strict=True):
            if start is not None:
                self._start(start)
            if trade is not None and leg == 1:
                self.volume += f32(trade)
                self.rate += one
            if not (bids and asks and last and open_):
                out.append((False, 0, 0, None, None, None, None, None))
                continue
            self.volume, self.rate = self.volume * decay, self.rate * decay
            spread = asks[0] - bids[0]
            mid = bids[0] + int(spread / 2)
            x = f32(mid)
            if self.fast is None:
                self.fast, self.middle, self.slow, self.moves = x, x, x, f32(0)
            else:
                self.fast += quick * (x - self.fast)
                self.middle += mild * (x - self.middle)
                self.slow += calm * (x - self.slow)
                self.moves += calm * (f32(abs(mid - self.before)) - self.moves)
            self.before = mid
            if spread:
                inverse = one / f32(spread)
                by = ((self.fast - self.middle) * inverse, (self.middle - self.slow) * inverse, self.moves * inverse)
            else:
                by = (None, None, None)
            out.append((True, mid, spread, by[0], by[1], self.volume / thousand, self.rate, by[2]))
        names = ("kept", "mid", "spread", "mom_fast", "mom_slow", "signed_vol", "trade_rate", "realized_vol")
        return f | dict(zip(names, map(list, zip(*out, strict=True)) if out else ([] for _ in names), strict=True))


class SummaryStage:
    """One row per batch of a chunk: what its rows do to the state of ``FeatureStage``."""

    def __init__(self, keep: Callable[[Columns], list[bool]] | None = None):
        self.keep, self.part = keep, 0

    def __call__(self, f: Columns) -> Columns:
        n = len(f["bid_px"])
        trades, legs, lasts = f.get("trade") or [None] * n, f.get("leg") or [1] * n, f.get("last_leg") or [True] * n
        gate = self.keep(f) if self.keep else [True] * n
        kept = np.array([bool(b and a and last and ok and seq is not None) for b, a, last, ok, seq in zip(f["bid_px"], f["ask_px"], lasts, gate, f["seq"], strict=True)], bool)
        mids = np.array([b[0] + int((a[0] - b[0]) / 2) for b, a, k in zip(f["bid_px"], f["ask_px"], kept, strict=True) if k], float)
        counts = np.array([t is not None and leg == 1 for t, leg in zip(trades, legs, strict=True)], float)
        sizes = np.array([float(t) if c else 0.0 for t, c in zip(trades, counts, strict=True)], float)
        row = {"locate": f["locate"][0], "chunk": f["chunk"][0], "part": self.part} | summary(mids, kept, sizes, counts)
        self.part += 1
        return {name: [value] for name, value in row.items()}


FEATURE_COLUMNS = "kept boolean, mid long, spread long, mom_fast float, mom_slow float, signed_vol float, trade_rate float, realized_vol float"
