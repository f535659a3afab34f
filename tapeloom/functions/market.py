"""Column functions of the market-data domain, all on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Regular trading hours in nanoseconds since midnight, half open.
MARKET_OPEN = 34_200_000_000_000
MARKET_CLOSE = 57_600_000_000_000
LEVELS = 5
MAX_LOCATE = 16_384
MAX_SPREAD = 2200
HORIZON = 100
THRESHOLD = 50
NEAR_RESUME_NS = 1_000_000


def in_hours(ts_ns: Column) -> Column:
    return (ts_ns >= F.lit(MARKET_OPEN)) & (ts_ns < F.lit(MARKET_CLOSE))


def ns_of_day(ts: Column) -> Column:
    """Nanoseconds since midnight of a TIMESTAMP_NTZ, whatever the session's zone."""
    us = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)
    return F.pmod(us, F.lit(86_400_000_000)) * 1000


def time_of_day(ns: Column) -> Column:
    s = F.floor(ns / F.lit(1_000_000_000)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60)


def symbol_name(raw: Column) -> Column:
    """An eight-byte symbol without its trailing spaces."""
    return F.rtrim(F.decode(raw, "US-ASCII"))


def f32(c: Column) -> Column:
    return c.cast("float")


def mid(bid: Column, ask: Column) -> Column:
    """Whole-number middle; the half spread is cut toward zero."""
    return bid + ((ask - bid) / 2).cast("long")


def two_sided(bid_px: Column, ask_px: Column) -> Column:
    return (F.size(bid_px) > 0) & (F.size(ask_px) > 0)


def consistent(bid_px: Column, ask_px: Column) -> Column:
    """A book with an empty side is consistent; one that is locked or crossed isn't."""
    return ~two_sided(bid_px, ask_px) | (F.try_element_at(bid_px, F.lit(1)) < F.try_element_at(ask_px, F.lit(1)))


def qty_over(qty: Column, k: int) -> Column:
    """Sum of the first k quantities as a float."""
    return f32(F.aggregate(F.slice(qty, 1, k), F.lit(0).cast("long"), lambda n, q: n + q))


def imbalance(bid_qty: Column, ask_qty: Column, k: int) -> Column:
    b, a = qty_over(bid_qty, k), qty_over(ask_qty, k)
    return f32(f32(b - a) / f32(b + a))


def relative_spread(spread: Column, middle: Column) -> Column:
    return f32(f32(f32(spread) / f32(middle)) * F.lit(1e4).cast("float"))


def microprice_deviation(bid: Column, ask: Column, bid_qty: Column, ask_qty: Column, middle: Column, spread: Column) -> Column:
    """Null where the spread is zero."""
    b, a = f32(bid_qty), f32(ask_qty)
    top = f32(f32(f32(bid) * a) + f32(f32(ask) * b))
    return F.when(spread != 0, f32(f32(f32(top / f32(b + a)) - f32(middle)) / f32(spread)))


def over_spread(x: Column, spread: Column) -> Column:
    """x times the float reciprocal of the spread; null where it is zero."""
    return F.when(spread != 0, f32(f32(x) * f32(F.lit(1.0).cast("float") / f32(spread))))


def log_depth(qty: Column) -> Column:
    return f32(F.log1p(qty_over(qty, LEVELS)))


def log2_bucket(v: Column) -> Column:
    """0 for 0, else b with v in [2^(b-1), 2^b), 39 at most."""
    return F.when(v == 0, 0).otherwise(F.least(F.length(F.bin(v)), F.lit(39))).cast("int")


def quantize(v: Column, scale: Column) -> Column:
    """Round half to even of v/scale, held to -127..127; what isn't a number, or is 2**63 or
    more, is -127."""
    r = f32(f32(v) / f32(scale))
    big = F.isnan(r) | (r >= F.lit(float(2**63)))
    return F.when(big, F.lit(-127)).otherwise(F.greatest(F.lit(-127), F.least(F.lit(127), F.rint(F.when(big, F.lit(0.0)).otherwise(r))))).cast("int")


def first_argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
