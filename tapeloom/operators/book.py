"""Books, integrity counts and features of a feed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tapeloom.functions import market as m
from tapeloom.operators.chunks import SUMMARY, Chunks, last_before, running, starts, with_carried
from tapeloom.operators.fold import BOOK_COLUMNS, FEATURE_COLUMNS, LIFE_SCHEMA, ORDER_SCHEMA, BookStage, Columns, FeatureStage, LifeStage, OrderStage, SummaryStage, symbol_fold
from tapeloom.operators.links import connected_components
from tapeloom.staging import staged

Gate = Callable[[Columns], list[bool]] | None
LEVEL_COLUMNS = "seq long, locate long, ts_ns long, event_type string, side string, price long, qty long"


ORDER_TYPES = ("A", "F", "E", "C", "X", "D", "U")


def order_fold(messages: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Messages -> level updates and statuses, one row per leg. Symbols are folded whole, unless
    one is hot: then all orders are folded by their lives."""
    if Chunks(messages, hot_rows=hot_rows).any:
        return order_fold_by_life(messages, hot_rows)
    return symbol_fold(messages, [OrderStage], ORDER_SCHEMA)


def order_fold_by_life(messages: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """``order_fold`` without a task that holds a symbol.

    Replaces link references; what hangs together is the life of one order, folded apart from
    all others. Messages about references that nothing adds are unknown as they are. Lives give
    changes, and running sums of them along each level and each symbol the totals: what an order
    loses it had before, so that no total falls below zero. Rows go by the order's symbol.
    """
    extra = [c for c in ("state", "since") if c in messages.columns]
    m = staged(messages.where(F.col("msg_type").isin(*ORDER_TYPES)), "messages")
    replaces = m.where("msg_type = 'U' and new_ref is not null").select("ref", "new_ref")
    adds = staged(m.where(F.col("msg_type").isin("A", "F")).select("ref").union(replaces.select("new_ref")).where("ref is not null").distinct(), "added-refs")
    roots = connected_components(replaces.join(adds, "ref", "left_semi").select(F.col("ref").alias("a"), F.col("new_ref").alias("b")))
    known = adds.join(roots, adds["ref"] == roots["node"], "left").select("ref", F.coalesce("root", "ref").alias("root"))
    rows = staged(m.join(known, "ref", "left"), "messages-by-life")
    schema = LIFE_SCHEMA + "".join(f", {c} {m.schema[c].dataType.simpleString()}" for c in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stage = LifeStage()
        for b in batches:
            out = stage({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns, strict=True)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    lives = rows.where("root is not null").repartition("root").sortWithinPartitions("root", "seq").mapInArrow(run, schema)
    lost = rows.where("root is null").select("seq", "locate", "ts_ns", "msg_type", F.lit(1).alias("leg"), F.lit("unknown_ref").alias("status"), F.lit(True).alias("last_leg"), F.lit(0).cast("long").alias("born"), *extra)
    changes = staged(lives.unionByName(lost, allowMissingColumns=True), "order-changes")
    order = ["seq", "leg"]
    priced = running(changes.where("price is not null"), ["locate", "side", "price"], order, {"qty": "change"}, hot_rows)
    levels = staged(priced.unionByName(changes.where("price is null"), allowMissingColumns=True), "order-levels")
    out = running(levels, ["locate"], order, {"resting": "born"}, hot_rows)
    return out.select("seq", "locate", "ts_ns", "msg_type", "leg", "status", "trade", "last_leg", "side", "price", "qty", "resting", *extra)


def _folded(rows: DataFrame, stages: list, schema: str, chunks: Chunks, order: str | list[str] = "seq", dealt: bool = False) -> DataFrame:
    """Books of rows that change levels; those of a hot symbol begin with the levels that their
    chunk finds."""
    if not chunks.any:
        return symbol_fold(rows, stages, schema, order=order, dealt=dealt)
    return symbol_fold(with_carried(chunks.deal(rows)), stages, schema, key=["locate", "chunk"], order=order).where("seq is not null")


def _recurrent(rows: DataFrame, schema: str, gate: Gate, chunks: Chunks, order: str | list[str] = "seq") -> DataFrame:
    """Books and recurrent features of hot symbols: chunks are summed up as affine maps, and
    worked through from the state that earlier ones lead to. That state comes from sums in double
    precision, and differs from a fold's in one go by what single precision has lost: of the
    averages half a unit of the price over the rate at most, which is 3 at a price of a million
    and the rate of 0.01. ``symbol_fold`` of all rows of a symbol stays the exact way."""
    keys = ["locate", "chunk"]
    dealt = staged(with_carried(chunks.deal(rows)), "chunks")
    begin = starts(symbol_fold(dealt, [BookStage, partial(SummaryStage, gate)], SUMMARY, key=keys, order=order))
    return symbol_fold(dealt.unionByName(begin, allowMissingColumns=True), [BookStage, partial(FeatureStage, gate)], schema, key=keys, order=order).where("seq is not null")


def books(updates: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Level updates -> the book after each."""
    action = ", action string" if "action" in updates.columns else ""
    return _folded(updates, [BookStage], f"{LEVEL_COLUMNS}{action}, {BOOK_COLUMNS}", Chunks(updates, hot_rows=hot_rows))


def books_with_states(updates: DataFrame, states: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Level updates -> the book after each, and the trading state as of it: states and updates
    are dealt by symbol once, for both."""
    chunks = Chunks(updates, hot_rows=hot_rows)
    return _folded(state_as_of(updates, states, chunks), [BookStage], f"{LEVEL_COLUMNS}, state string, since long, {BOOK_COLUMNS}", chunks, dealt=True)


def missing(rows: DataFrame, order: str = "seq", width: int = 1 << 20) -> DataFrame:
    """``first, last`` of every gap in a column of whole numbers. Neighbours are compared within
    ranges of the column, and across them by the ranges' ends."""
    dealt = rows.select(F.col(order).alias("at"), F.floor(F.col(order) / width).alias("range"))
    inside = dealt.select("at", F.lag("at").over(Window.partitionBy("range").orderBy("at")).alias("before"))
    ends = dealt.groupBy("range").agg(F.min("at").alias("at"), F.max("at").alias("end"))
    across = ends.select("at", F.lag("end").over(Window.orderBy("range")).alias("before"))  # a row per range
    return inside.unionAll(across).where("at > before + 1").select((F.col("before") + 1).alias("first"), (F.col("at") - 1).alias("last"))


def resynced_books(updates: DataFrame, snapshots: DataFrame, hot_rows: int | None = None, at: DataFrame | None = None) -> DataFrame:
    """The book after each of ``updates`` that can be trusted, of a feed whose ordinals have gaps.

    A gap may have lost a change of any symbol, so that from it on a symbol's book is stale
    until its next snapshot: ``snapshots(seq, locate, side, price, qty)`` give all levels as of an
    ordinal, in place of whatever the book holds, and a row without a price for a symbol without
    levels. Updates while a book is stale are dropped; snapshots themselves give no rows.

    With ``at(seq)`` the snapshots are of all symbols, at those ordinals, and a level that stands
    in many of them is given once: it is in those from ``seq`` to ``until``, or to the last if that
    is null.

    Of a snapshot only what can change the book is applied: levels updated since the one before
    and those that came, went or changed between the two, if any update follows. So the rows
    grow with updates and snapshot rows, not with symbols times gaps.
    """
    level, action = ["locate", "side", "price"], [c for c in ("action",) if c in updates.columns]
    mark = lambda seq, whole: (F.lit(0).alias("_all"), F.col(seq).alias("seq"), F.struct(F.col(seq).alias("at"), F.lit(whole).alias("whole")).alias("_mark"))
    marks = missing(updates).select(*mark("last", False))
    if at is not None:
        marks = marks.unionAll(at.select(*mark("seq", True)))
    rows = updates.withColumn("_all", F.lit(0))
    rows = last_before(rows, marks, ["_all"], "seq", "_mark", Chunks(rows, ["_all"], hot_rows=hot_rows))
    if at is not None:  # a gap that ends later than the last snapshot leaves all books stale
        rows, spans = rows.withColumn("_known", F.when(F.col("_mark.whole"), F.col("_mark.at"))), snapshots.select("seq", "until", *level, "qty")
    else:
        own = snapshots.select("locate", "seq", F.col("seq").alias("_known")).distinct()
        rows, spans = last_before(rows, own, ["locate"], "seq", "_known", Chunks(rows, hot_rows=hot_rows)), snapshots.select("seq", F.col("seq").alias("until"), *level, "qty")
    rows = staged(rows.where("_mark is null or _known >= _mark.at").select(*updates.columns, "_known"), "trusted")
    spans = spans.where("price is not null")

    # the places after which a level may differ, and the first snapshot in use from there on
    used = rows.select("locate", F.col("_known").alias("_at")).where("_at is not null").distinct()
    after = rows.where("price is not null").select(*level, (F.col("seq") + 1).alias("seq"))
    after = after.unionAll(spans.select(*level, "seq")).unionAll(spans.where("until is not null").select(*level, (F.col("until") + 1).alias("seq")))
    first = lambda places: last_before(places.withColumn("seq", -F.col("seq")), used.withColumn("seq", -F.col("_at")), ["locate"], "seq", "_at").where("_at is not null")
    wanted = first(after).select(*level, F.col("_at").alias("seq"))
    if action:  # of a book that the feed itself has cleared all levels are
        cleared = first(rows.where("action = 'clear'").select("locate", (F.col("seq") + 1).alias("seq"))).select("locate", "_at")
        wanted = wanted.unionAll(spans.join(cleared, "locate").where("seq <= _at and (until is null or until >= _at)").select(*level, F.col("_at").alias("seq")))
    held = spans.select(*level, "seq", F.struct("until", "qty").alias("_held"))
    found = last_before(wanted.distinct(), held, level, "seq", "_held")
    stands = F.col("_held.until").isNull() | (F.col("_held.until") >= F.col("seq"))
    fixes = found.select(*level, "seq", F.lit(1).alias("leg"), F.when(stands, F.coalesce("_held.qty", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("qty"))
    feed = rows.drop("_known").withColumn("leg", F.lit(2)).unionByName(fixes, allowMissingColumns=True)
    feed = staged(feed, "resynced")
    out = _folded(feed, [BookStage], f"{LEVEL_COLUMNS}, leg int, {BOOK_COLUMNS}", Chunks(feed, hot_rows=hot_rows), ["seq", "leg"])
    return out.where("leg = 2").drop("leg")


def order_books(messages: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Messages -> the book after each leg, in one pass over each symbol that isn't hot."""
    schema = f"{ORDER_SCHEMA}, {BOOK_COLUMNS}"
    if not Chunks(messages, hot_rows=hot_rows).any:
        return symbol_fold(messages, [OrderStage, BookStage], schema)
    legs = staged(order_fold_by_life(messages, hot_rows), "legs")
    return _folded(legs, [BookStage], schema, Chunks(legs, hot_rows=hot_rows), ["seq", "leg"])


def level_features(updates: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Level updates -> book and recurrent features after each."""
    schema, chunks = f"{LEVEL_COLUMNS}, {BOOK_COLUMNS}, {FEATURE_COLUMNS}", Chunks(updates, hot_rows=hot_rows)
    return _recurrent(updates, schema, None, chunks) if chunks.any else symbol_fold(updates, [BookStage, FeatureStage], schema)


def order_features(messages: DataFrame, gate: str = "none", dealt: bool = False, hot_rows: int | None = None) -> DataFrame:
    """Messages -> book and recurrent features after each leg.

    ``gate``: ``none`` computes on every two-sided message, ``hours`` only in market hours,
    ``serve`` also needs the column ``state`` of the messages to be T.
    """
    schema = f"{ORDER_SCHEMA}, {'state string, ' if gate == 'serve' else ''}{BOOK_COLUMNS}, {FEATURE_COLUMNS}"
    if not Chunks(messages, hot_rows=hot_rows).any:
        return symbol_fold(messages, [OrderStage, BookStage, partial(FeatureStage, _GATES[gate])], schema, dealt=dealt)
    legs = staged(order_fold_by_life(messages, hot_rows), "legs")
    return _recurrent(legs, schema, _GATES[gate], Chunks(legs, hot_rows=hot_rows), ["seq", "leg"])


def served_features(messages: DataFrame, states: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """``order_features`` as they are served: in hours, while the symbol trades. States and
    messages are dealt by symbol once, for the states and the folds behind them."""
    chunks = Chunks(messages, hot_rows=hot_rows)
    return order_features(state_as_of(messages, states, chunks), "serve", dealt=not chunks.any, hot_rows=hot_rows)


def _in_hours(f: Columns) -> list[bool]:
    return [t is not None and m.MARKET_OPEN <= t < m.MARKET_CLOSE for t in f["ts_ns"]]


def _serving(f: Columns) -> list[bool]:
    return [ok and state == "T" for ok, state in zip(_in_hours(f), f["state"], strict=True)]


_GATES = {"none": None, "hours": _in_hours, "serve": _serving}


def best(px: Column) -> Column:
    """Best price of a side, 0 if it is empty."""
    return F.coalesce(F.try_element_at(px, F.lit(1)), F.lit(0))


def with_touch(book: DataFrame) -> DataFrame:
    two = m.two_sided(F.col("bid_px"), F.col("ask_px"))
    return book.withColumns({"best_bid": best(F.col("bid_px")), "best_ask": best(F.col("ask_px")), "two_sided": two, "crossed": ~m.consistent(F.col("bid_px"), F.col("ask_px"))})


def crossings(book: DataFrame) -> DataFrame:
    b = with_touch(book)
    return b.where("crossed").withColumn("depth", F.col("best_bid") - F.col("best_ask"))


def state_as_of(rows: DataFrame, states: DataFrame, chunks: Chunks | None = None) -> DataFrame:
    """Rows with the last state of their symbol up to their sequence number, and its time; T
    and 0 before the first. The result is dealt by symbol, as ``symbol_fold`` asks, unless
    symbols are cut into ``chunks``."""
    out = last_before(rows, states.select("locate", "seq", F.struct("state", F.col("ts_ns").alias("since")).alias("_last")), ["locate"], "seq", "_last", chunks)
    return out.select(*rows.columns, F.coalesce("_last.state", F.lit("T")).alias("state"), F.coalesce("_last.since", F.lit(0)).alias("since"))


def crossing_report(crossed: DataFrame) -> DataFrame:
    """Per symbol: crossings, those while halted, those shortly after a change of state, and
    the deepest. Needs the columns of ``crossings`` and ``state_as_of``."""
    near = (F.col("state") == "T") & (F.col("ts_ns") - F.col("since") < m.NEAR_RESUME_NS)
    return crossed.groupBy("locate").agg(
        F.count("*").alias("crossings"),
        F.count_if(F.col("state") != "T").alias("while_halted"),
        F.count_if(near).alias("near_resume"),
        F.greatest(F.max("depth"), F.lit(0)).alias("worst"),
    )


def qty_at(updates: DataFrame, wanted: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """``wanted(locate, seq, side, price)`` with the quantity at that level as of seq, 0 if
    there is none: the last update of the level, carried along in its order."""
    level = ["locate", "side", "price"]
    both = updates.select(*level, "seq").unionByName(wanted.select(*level, "seq"))
    out = last_before(wanted.select(*level, "seq"), updates.select(*level, "seq", "qty"), level, "seq", "qty", Chunks(both, level, hot_rows=hot_rows))
    return out.withColumn("qty", F.coalesce("qty", F.lit(0)))


def stateless_features(book: DataFrame) -> DataFrame:
    """Mid, spread and the eleven features that need only the book of the row. Those divided
    by the spread are null where it is zero."""
    c, first, last = F.col, lambda x: F.try_element_at(x, F.lit(1)), lambda x: F.try_element_at(x, F.lit(-1))
    bid, ask = first(c("bid_px")), first(c("ask_px"))
    b = book.where(m.two_sided(c("bid_px"), c("ask_px"))).withColumns({"mid": m.mid(bid, ask), "spread": ask - bid})
    out = {f"imb{k}": m.imbalance(c("bid_qty"), c("ask_qty"), k) for k in (1, 3, 5)}
    out |= {
        "rel_spread": m.relative_spread(c("spread"), c("mid")),
        "microdev": m.microprice_deviation(bid, ask, first(c("bid_qty")), first(c("ask_qty")), c("mid"), c("spread")),
        "log_bid": m.log_depth(c("bid_qty")),
        "log_ask": m.log_depth(c("ask_qty")),
        "bid_slope": m.over_spread(bid - last(c("bid_px")), c("spread")),
        "ask_slope": m.over_spread(last(c("ask_px")) - ask, c("spread")),
        "bid_fill": m.f32(m.f32(F.size("bid_px")) / F.lit(5.0).cast("float")),
        "ask_fill": m.f32(m.f32(F.size("ask_px")) / F.lit(5.0).cast("float")),
    }
    return b.withColumns(out)


#: The sixteen features in their order.
FEATURES = ("imb1", "imb3", "imb5", "rel_spread", "microdev", "mom_fast", "mom_slow", "signed_vol", "trade_rate", "log_bid", "log_ask", "bid_slope", "ask_slope", "bid_fill", "ask_fill", "realized_vol")


def feature_records(folded: DataFrame) -> DataFrame:
    """``seq, locate, ts_ns, mid, spread, f``: the record of each row that was kept."""
    rows = stateless_features(folded.where("kept"))
    return rows.select("seq", "locate", "ts_ns", "mid", "spread", F.array(*FEATURES).alias("f"))


def access_profile(book: DataFrame) -> DataFrame:
    """Per update with a price: side depth and rank it found, and whether it modified,
    inserted or erased a level, or touched nothing; the elements a flat array would move."""
    b = book.where("found is not null")
    kind = F.when(F.col("existed") & (F.col("qty") != 0), "modify").when(F.col("existed"), "erase").when(F.col("qty") != 0, "insert").otherwise("none")
    moved = F.when(kind == "erase", F.col("found") - F.col("rank") - 1).when(kind == "insert", F.col("found") - F.col("rank"))
    return b.withColumns({"op": kind, "moved": moved})
