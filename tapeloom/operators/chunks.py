"""Hot symbols in chunks: what lets many tasks share the rows of one key, in order.

A key with more rows than ``HOT_ROWS`` is cut into chunks, ranges of its sequence numbers; every
other key is one chunk. What a chunk hands on is small and associative (last quantities of
levels, sums, affine maps), so chunks are summed up apart, combined along their key, and worked
through apart again, each from what came before it. Results don't depend on where chunks end.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.staging import staged

#: Rows of a key from which on it is cut.
HOT_ROWS = 1 << 20


class Chunks:
    """Where the hot keys of ``rows`` are cut: ``keys``, the first sequence number ``_lo`` and
    the range ``_width`` of a chunk. A row per hot key, so fewer than rows / ``hot_rows``."""

    def __init__(self, rows: DataFrame, keys: Sequence[str] = ("locate",), order: str = "seq", hot_rows: int | None = None):
        size = HOT_ROWS if hot_rows is None else hot_rows
        self.keys, self.order, self.any = list(keys), order, False
        if rows.count() <= size:  # then no key has more
            return
        counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(order).alias("_lo"), F.max(order).alias("_hi")).where(F.col("_n") > size)
        width = F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.ceil(F.col("_n") / size))
        self.table = staged(counts.select(*keys, "_lo", width.alias("_width")), "hot-keys")
        self.any = not self.table.isEmpty()

    def deal(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their ``chunk``; the engine broadcasts the table if it is small."""
        at = F.greatest(F.floor((F.col(self.order) - F.col("_lo")) / F.col("_width")), F.lit(0))
        return rows.join(self.table, self.keys, "left").withColumn("chunk", F.coalesce(at, F.lit(0))).drop("_lo", "_width")


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, str], hot_rows: int | None = None) -> DataFrame:
    """Running sums of columns along each key, by name. ``rows`` are read several times."""
    chunks = Chunks(rows, keys, order[0], hot_rows)
    if not chunks.any:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({name: F.sum(value).over(upto) for name, value in sums.items()})
    dealt = chunks.deal(rows)
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # chunks of a key
    totals = dealt.groupBy(*keys, "chunk").agg(*[F.sum(v).alias(f"_{n}") for n, v in sums.items()])
    before = totals.select(*keys, "chunk", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({name: F.sum(value).over(inside) for name, value in sums.items()}).join(before, [*keys, "chunk"])
    return out.withColumns({name: F.coalesce(F.col(name), F.lit(0)) + F.col(f"_{name}") for name in sums}).drop("chunk", *[f"_{n}" for n in sums])


def last_before(rows: DataFrame, marks: DataFrame, keys: Sequence[str], order: str, value: str, chunks: Chunks | None = None) -> DataFrame:
    """``rows`` with ``value``, that of the last of ``marks`` of their key up to their place; null
    before the first. A mark at a row's own place counts, and of marks at one place the largest.

    Rows and marks of a key are put in order together and the last mark is carried along: within
    a chunk, and from the last marks of earlier chunks into it. The result is dealt by key, or
    by key and chunk if some are cut; ``chunks`` are those of the rows unless given.
    """
    row = F.struct("*")
    mine = rows.select(*keys, order, F.lit(1).alias("_side"), F.lit(None).cast(marks.schema[value].dataType).alias("_mark"), row.alias("_row"))
    known = marks.select(*keys, order, F.lit(0).alias("_side"), F.col(value).alias("_mark"), F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"))
    both = known.unionByName(mine)
    chunks = chunks or Chunks(both.select(*keys, order), keys, order)
    if chunks.any:
        both = chunks.deal(both)
        ends = both.groupBy(*keys, "chunk").agg(F.max_by("_mark", F.when(F.col("_side") == 0, F.struct(order, "_mark"))).alias("_end"))
        earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # chunks of a key
        carried = ends.select(*keys, "chunk", F.last("_end", ignorenulls=True).over(earlier).alias("_mark")).where("_mark is not null")
        both = both.unionByName(carried.withColumns({order: F.lit(None).cast(both.schema[order].dataType), "_side": F.lit(0), "_row": F.lit(None).cast(mine.schema["_row"].dataType)}))
        keys = [*keys, "chunk"]
    last = F.last("_mark", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_first(), "_side", "_mark").rowsBetween(Window.unboundedPreceding, 0))
    return both.repartition(*keys).withColumn(value, last).where("_side = 1").select("_row.*", value)


# ---- books -------------------------------------------------------------------------------
def carried_levels(dealt: DataFrame) -> DataFrame:
    """The levels that a chunk finds, as rows without a sequence number: of every level the last
    quantity of an earlier chunk, unless that is 0 or a row with the action ``clear`` lies
    between. ``dealt(locate, chunk, seq, side, price, qty, action)``; without the column
    ``action`` nothing is cleared."""
    action = F.col("action") if "action" in dealt.columns else F.lit(None).cast("string")
    rows = dealt.select("locate", "chunk", "seq", *[c for c in ("leg",) if c in dealt.columns], "side", "price", "qty", action.alias("action"))
    place = F.struct("seq", "leg") if "leg" in dealt.columns else F.struct("seq")
    each = rows.groupBy("locate", "chunk").agg(F.max(F.when(F.col("action") == "clear", place)).alias("_cleared"))
    symbol = Window.partitionBy("locate").orderBy("chunk")  # chunks of a symbol
    later = symbol.rowsBetween(1, Window.unboundedFollowing)
    every = Window.partitionBy("locate")
    ends = each.withColumn("_upto", F.coalesce(F.min(F.when(F.col("_cleared").isNotNull(), F.col("chunk"))).over(later), F.max("chunk").over(every)))
    live = rows.where("price is not null").join(ends, ["locate", "chunk"]).where(F.col("_cleared").isNull() | (place >= F.col("_cleared")))
    last = live.groupBy("locate", "side", "price", "chunk", "_upto").agg(F.max_by("qty", place).alias("qty"))
    touched = F.lead("chunk").over(Window.partitionBy("locate", "side", "price").orderBy("chunk"))
    spans = last.withColumn("_to", F.least("_upto", F.coalesce(touched, F.col("_upto")))).where("qty > 0 and _to > chunk")
    return spans.select("locate", F.explode(F.sequence(F.col("chunk") + 1, F.col("_to"))).alias("chunk"), "side", "price", "qty")


def with_carried(dealt: DataFrame) -> DataFrame:
    """``dealt`` rows and, without a sequence number, the levels that each chunk finds."""
    return dealt.unionByName(carried_levels(dealt), allowMissingColumns=True)


# ---- recurrences -------------------------------------------------------------------------
#: Steps of the averages of the middle price and of its moves, and what trades decay by.
RATES = {"fast": 0.10, "middle": 0.03, "slow": 0.01, "moves": 0.01}
DECAY = 0.999
MAPS = ("fast", "middle", "slow", "moves", "volume", "rate")
SUMMARY = "locate long, chunk long, part long, n long, first double, last double, fast double, middle double, slow double, moves double, volume double, rate double"


def summary(mids: np.ndarray, kept: np.ndarray, trades: np.ndarray, counts: np.ndarray) -> dict[str, float]:
    """What consecutive rows do to the recurrent state, as affine maps.

    ``mids`` are those of the rows kept; ``kept``, ``trades`` and ``counts`` cover all rows. A
    state s becomes (1 - rate)^n s + b, and b is what is stored. Of ``moves`` the term of the
    first middle price is left out, as it asks for the one before.
    """
    n = len(mids)
    out: dict[str, float] = {"n": n, "first": mids[0] if n else np.nan, "last": mids[-1] if n else np.nan}
    for name, rate in RATES.items():
        x = np.abs(np.diff(mids)) if name == "moves" else mids
        out[name] = float(rate * ((1 - rate) ** np.arange(len(x))[::-1] @ x)) if len(x) else 0.0
    weights = DECAY ** np.cumsum(kept[::-1])[::-1]
    return out | {"volume": float(weights @ trades), "rate": float(weights @ counts)}


def compose(parts: pd.DataFrame) -> pd.DataFrame:
    """Row i: the maps of rows 0 to i, one after the other."""
    out, state = [], None
    for p in parts.itertuples():
        if state is None:
            state = {"n": p.n, "first": p.first, "last": p.last} | {m: getattr(p, m) for m in MAPS}
        else:
            for m in MAPS:
                state[m] = (1 - RATES[m] if m in RATES else DECAY) ** p.n * state[m] + getattr(p, m)
            if p.n and state["n"]:
                state["moves"] += RATES["moves"] * (1 - RATES["moves"]) ** (p.n - 1) * abs(p.first - state["last"])
            if p.n:
                state |= {"first": state["first"] if state["n"] else p.first, "last": p.last, "n": state["n"] + p.n}
        out.append(dict(state))
    return pd.DataFrame(out, columns=["n", "first", "last", *MAPS])


def starts(summaries: DataFrame) -> DataFrame:
    """``SUMMARY`` rows -> ``locate, chunk, start``: the state that a chunk starts from, an array of
    fast, middle and slow average, average move, last middle price, volume and rate. The parts
    of a chunk are composed first, then the chunks of a symbol."""

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        return compose(frame).tail(1).assign(locate=frame.locate.iloc[0], chunk=frame.chunk.iloc[0], part=0)[[c.split()[0] for c in SUMMARY.split(", ")]]

    def along(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk", ignore_index=True)
        s = compose(frame)
        # the first middle price starts the averages, which is to start from it and step to it
        values = [s[m] + (1 - RATES[m]) ** s.n * s["first"] for m in ("fast", "middle", "slow")]
        values = np.column_stack([*values, s.moves, s["last"], s.volume, s.rate])
        later = frame.iloc[1:]
        return pd.DataFrame({"locate": later.locate, "chunk": later.chunk, "start": pd.Series(values[:-1].tolist(), later.index, object)})

    chunks = summaries.groupBy("locate", "chunk").applyInPandas(whole, SUMMARY)
    return chunks.groupBy("locate").applyInPandas(along, "locate long, chunk long, start array<double>")
