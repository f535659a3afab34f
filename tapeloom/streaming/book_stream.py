"""The order and book folds over a stream, with keyed state: an entry for each order and each
level's total, and books as trees of small nodes. A message reads and writes what it touches;
what it costs doesn't grow with the number of orders or levels that a symbol has.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tapeloom.operators.book import LEVEL_COLUMNS
from tapeloom.operators.fold import BOOK_COLUMNS, LEVELS, ORDER_SCHEMA, Columns, OrderStage

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Bits of a price below each depth of a book's tree: nodes under the root have 256 entries at
#: most, the root one for each 2**24 steps of price that hold levels (256, for prices of four bytes).
SHIFTS = (24, 16, 8, 0)

_DTYPES = {"long": "Int64", "int": "Int32", "boolean": "boolean"}


class StateDict:
    """A map state as a dict that reads an entry when it is first asked for, and writes those
    that differ from what was read when it is flushed. Its length is counted from ``size``."""

    def __init__(self, state, pack: Callable[[Any], tuple], unpack: Callable[[tuple], Any], size: int = 0):
        self.state, self.pack, self.unpack, self.size = state, pack, unpack, size
        self.held: dict[tuple, Any] = {}
        self.read: dict[tuple, tuple | None] = {}
        self.emptied = False

    def get(self, key, default=None):
        key = key if isinstance(key, tuple) else (key,)
        if key not in self.held:
            found = None if self.emptied else self.state.getValue(key)
            self.read[key] = None if found is None else tuple(found)
            self.held[key] = None if found is None else self.unpack(found)
        value = self.held[key]
        return default if value is None else value

    def __contains__(self, key) -> bool:
        return self.get(key) is not None

    def __getitem__(self, key):
        value = self.get(key)
        if value is None:
            raise KeyError(key)
        return value

    def __setitem__(self, key, value) -> None:
        self.size += key not in self
        self.held[key if isinstance(key, tuple) else (key,)] = value

    def pop(self, key, default=None):
        value = self.get(key)
        if value is None:
            return default
        self.size -= 1
        self.held[key if isinstance(key, tuple) else (key,)] = None
        return value

    def __delitem__(self, key) -> None:
        if self.pop(key) is None:
            raise KeyError(key)

    def __len__(self) -> int:
        return self.size

    def clear(self) -> None:
        self.held, self.read, self.size, self.emptied = {}, {}, 0, True

    def flush(self) -> None:
        if self.emptied:
            self.state.clear()
        for key, value in self.held.items():
            packed = None if value is None else self.pack(value)
            if packed == self.read[key]:
                continue
            if packed is None:
                self.state.removeKey(key)
            else:
                self.state.updateValue(key, packed)


def pack_node(node: dict[int, int]) -> tuple[bytes]:
    return (array("q", [v for entry in sorted(node.items()) for v in entry]).tobytes(),)


def unpack_node(value: tuple) -> dict[int, int]:
    flat = array("q", bytes(value[0]))
    return dict(zip(flat[::2], flat[1::2], strict=True))


class TreeBook:
    """A book like ``BookStage``'s, over nodes by (side, depth, prefix): an entry has the number
    of levels under it, at the last depth the quantity of a level. Bids go by minus price, so
    that the best is first. ``counts`` has the number of levels of each side."""

    def __init__(self, nodes: StateDict, counts: dict[str, int]):
        self.nodes, self.counts, self.best = nodes, counts, {}

    def _first(self, side: str, depth: int, prefix: int, need: int) -> list[tuple[int, int]]:
        """The first ``need`` (key, quantity) under a node."""
        out: list[tuple[int, int]] = []
        for step, value in sorted(self.nodes.get((side, depth, prefix), {}).items()):
            if depth == len(SHIFTS) - 1:
                out.append((step, value))
            else:
                out += self._first(side, depth + 1, step, need - len(out))
            if len(out) >= need:
                break
        return out

    def top(self, side: str) -> tuple[list[int], list[int]]:
        if side not in self.best:
            first, sign = self._first(side, 0, 0, LEVELS), -1 if side == "B" else 1
            self.best[side] = [sign * k for k, _ in first], [q for _, q in first]
        return self.best[side]

    def put(self, side: str, price: int, qty: int | None) -> tuple[int, int, bool]:
        """Levels of the side before, how many are better than this one, and whether it is there."""
        key, found, rank = -price if side == "B" else price, self.counts[side], 0
        path = [(side, d, key >> SHIFTS[d - 1] if d else 0) for d in range(len(SHIFTS))]
        steps = [key >> s for s in SHIFTS]
        nodes = [self.nodes.get(p) or {} for p in path]
        existed = steps[-1] in nodes[-1]
        for depth, (node, step) in enumerate(zip(nodes, steps, strict=True)):
            rank += sum(1 if depth == len(SHIFTS) - 1 else n for at, n in node.items() if at < step)
        change = bool(qty) - existed
        if qty:
            nodes[-1][steps[-1]] = qty
        elif existed:
            del nodes[-1][steps[-1]]
        if change:
            self.counts[side] += change
            for node, step in zip(nodes[:-1], steps[:-1], strict=True):
                node[step] = node.get(step, 0) + change
                if not node[step]:
                    del node[step]
        for p, node in zip(path, nodes, strict=True):
            if node:
                self.nodes[p] = node
            else:
                self.nodes.pop(p)
        if rank < LEVELS:  # a change beyond them leaves the best levels as they are
            self.best.pop(side, None)
        return found, rank, existed

    def __call__(self, f: Columns) -> Columns:
        actions = f.get("action") or [None] * len(f["side"])
        out: list[tuple] = []
        for side, price, qty, action in zip(f["side"], f["price"], f["qty"], actions, strict=True):
            if action == "clear":
                self.nodes.clear()
                self.counts.update(B=0, S=0)
                self.best = {}
            found = rank = existed = None
            if price is not None:
                found, rank, existed = self.put(side, price, qty)
            out.append((*self.top("B"), *self.top("S"), self.counts["B"], self.counts["S"], found, rank, existed))
        names = ("bid_px", "bid_qty", "ask_px", "ask_qty", "bid_levels", "ask_levels", "found", "rank", "existed")
        return f | dict(zip(names, map(list, zip(*out, strict=True)) if out else ([] for _ in names), strict=True))


class FoldProcessor(StatefulProcessor):
    """A symbol's rows of a micro-batch, in order, through the folds; late rows are left out."""

    def __init__(self, schema: str, with_orders: bool, order: str):
        self.types = [tuple(c.strip().split(" ", 1)) for c in schema.split(",")]
        self.with_orders, self.order = with_orders, order

    def init(self, handle) -> None:
        self.progress = handle.getValueState("progress", "last long, resting long, bids long, asks long")
        self.nodes = handle.getMapState("nodes", "side string, depth int, prefix long", "entries binary")
        if self.with_orders:
            self.orders = handle.getMapState("orders", "ref long", "price long, shares long, side string")
            self.totals = handle.getMapState("totals", "side string, price long", "shares long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        last, resting, bids, asks = self.progress.get() if self.progress.exists() else (None, 0, 0, 0)
        if last is not None:
            frame = frame[frame[self.order] > last]
        if not len(frame):
            return
        last = int(frame[self.order].iloc[-1])
        # numbers that pandas holds as floats, for a null among them, are whole again
        part = {c: [None if v is None or v is pd.NA or v != v else int(v) if isinstance(v, float) else v for v in frame[c].tolist()] for c in frame}
        nodes = StateDict(self.nodes, pack_node, unpack_node)
        kept = [nodes]
        if self.with_orders:
            stage = OrderStage()
            stage.orders = StateDict(self.orders, tuple, list, resting)
            stage.levels = StateDict(self.totals, lambda v: (v,), lambda v: v[0])
            kept += [stage.orders, stage.levels]
            part = stage(part)
            resting = len(stage.orders)
        book = TreeBook(nodes, {"B": bids, "S": asks})
        part = book(part)
        for state in kept:
            state.flush()
        self.progress.update((last, resting, book.counts["B"], book.counts["S"]))
        yield pd.DataFrame({c: pd.Series(part[c], dtype=_DTYPES.get(kind, object)) for c, kind in self.types})


def _stream_fold(rows: DataFrame, schema: str, with_orders: bool, key: str = "locate", order: str = "seq") -> DataFrame:
    """``rows`` of a stream folded per symbol; output in append mode.

    A micro-batch is put in order by sequence. Rows at or before the last sequence that a
    symbol has seen are late; a feed of changes can't be mended by them, so they are left out
    of the fold (and of the result, where a join with the input finds them). Map states are
    kept by the RocksDB provider, which the session must name.
    """
    if rows.sparkSession.conf.get(PROVIDER, None) != ROCKS:
        raise ValueError(f"set {PROVIDER} to {ROCKS}")
    return rows.groupBy(key).transformWithStateInPandas(FoldProcessor(schema, with_orders, order), schema, "Append", "None")


def stream_books(updates: DataFrame) -> DataFrame:
    """Level updates -> what ``operators.book.books`` gives for all rows up to each one."""
    return _stream_fold(updates, f"{LEVEL_COLUMNS}, {BOOK_COLUMNS}", False)


def stream_order_books(messages: DataFrame) -> DataFrame:
    """Order messages -> level updates with the book behind each."""
    return _stream_fold(messages, f"{ORDER_SCHEMA}, {BOOK_COLUMNS}", True)
