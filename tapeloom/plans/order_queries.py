"""Queries over the order feed: dispatch, the order fold, its counters and features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.operators import book as B
from tapeloom.operators.dataset import running_sum
from tapeloom.plans.sql import ORDER_FOLD, ORDERS
from tapeloom.sources import feeds

SAMPLE_EVERY = 64
#: Symbols from this number on are beyond the universe.
BOUND = 100


def order_feed(spark, sf):
    return feeds.order_messages(spark, sf)


def type_dispatch(spark, sf):
    kind = F.when(F.col("msg_type").isin("A", "F"), "add").when(F.col("msg_type").isin("E", "C", "X"), "reduce").when(F.col("msg_type") == "D", "delete").when(F.col("msg_type") == "U", "replace").otherwise("skipped")
    return feeds.order_messages(spark, sf).groupBy(kind.alias("action"), "msg_type").agg(F.count("*").alias("n"), F.sum("shares").alias("shares"))


def order_fold_status(spark, sf):
    return B.order_fold(feeds.order_messages(spark, sf)).where("last_leg").select("seq", "locate", "msg_type", "status")


def order_fold_levels(spark, sf):
    rows = B.order_fold(feeds.order_messages(spark, sf)).where("price is not null")
    return rows.select("seq", "locate", F.col("leg").cast("long").alias("leg"), "side", "price", "qty")


def order_counters(spark, sf):
    rows = B.order_fold(feeds.order_messages(spark, sf)).where("last_leg")
    last = rows.groupBy("locate").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "unknown_ref").alias("u"), F.count_if(F.col("status") == "bad_reduce").alias("b"), F.max_by("resting", "seq").alias("r"))
    return last.agg(F.sum("n").alias("applied"), F.sum("u").alias("unknown_ref"), F.sum("b").alias("bad_reduce"), F.sum("r").alias("resting"), F.count("*").alias("active"))


def run_counters(spark, sf):
    """The counters of a whole run: messages of symbols beyond the bound, skipped by their type,
    applied, rejected; events emitted with a two-sided book, and scored as they are served."""
    messages = feeds.order_messages(spark, sf)
    known = F.col("locate") < BOUND
    outside = messages.agg(F.count_if(~known).alias("bad_locate"), F.count_if(known & ~F.col("msg_type").isin(*"AFECXDU")).alias("skipped"))
    rows = B.served_features(messages.where(known), feeds.trading_states(spark, sf).where(known)).where("last_leg")
    emitted = (F.col("bid_levels") > 0) & (F.col("ask_levels") > 0)
    each = rows.groupBy("locate").agg(
        F.count("*").alias("a"), F.count_if(emitted).alias("e"), F.count_if("kept").alias("s"), F.count_if(F.col("status") == "unknown_ref").alias("u"), F.count_if(F.col("status") == "bad_reduce").alias("b"), F.max_by("resting", "seq").alias("r")
    )
    total = each.agg(F.sum("a").alias("applied"), F.sum("e").alias("emitted"), F.sum("s").alias("scored"), F.sum("u").alias("unknown_ref"), F.sum("b").alias("bad_reduce"), F.sum("r").alias("resting"), F.count("*").alias("active"))
    return outside.crossJoin(F.broadcast(total))  # one row each


def trade_attribution(spark, sf):
    rows = B.order_fold(feeds.order_messages(spark, sf)).where("trade is not null")
    return rows.select("seq", "locate", "trade", F.when(F.col("trade") > 0, "S").otherwise("B").alias("resting_side"))


def shared_refs(spark, sf):
    """References that more than one symbol uses: folding by the message's symbol is right
    only if there are none."""
    m = feeds.order_messages(spark, sf).where("ref >= 0")
    return m.groupBy("ref").agg(F.min("locate").alias("lo"), F.max("locate").alias("hi")).agg(F.count("*").alias("refs"), F.count_if(F.col("lo") != F.col("hi")).alias("shared"))


def order_book_touch(spark, sf):
    b = B.with_touch(B.order_books(feeds.order_messages(spark, sf))).where("last_leg")
    return b.select("seq", "best_bid", "best_ask", F.col("bid_levels").cast("long").alias("bid_levels"), F.col("ask_levels").cast("long").alias("ask_levels"))


def _flow(spark, sf):
    return B.order_features(feeds.order_messages(spark, sf)).where("kept")


def feat_decayed_volume(spark, sf):
    return _flow(spark, sf).select("seq", F.col("signed_vol").cast("double").alias("signed_vol"))


def feat_trade_rate(spark, sf):
    return _flow(spark, sf).select("seq", F.col("trade_rate").cast("double").alias("trade_rate"))


def served_records(spark, sf):
    """Features as they are served: only in hours, while the symbol trades."""
    records = B.feature_records(B.served_features(feeds.order_messages(spark, sf), feeds.trading_states(spark, sf)))
    return records.groupBy("locate").agg(F.count("*").alias("records"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def order_profile_mix(spark, sf):
    """What order messages do to levels, a replace's removal and addition apart."""
    p = B.access_profile(B.order_books(feeds.order_messages(spark, sf)))
    return p.groupBy((F.col("msg_type") == "U").alias("replace"), F.col("leg").cast("long").alias("leg"), "op").agg(F.count("*").alias("n"))


def peak_orders_sampled(spark, sf):
    """Resting orders of all symbols at every 64th message: each chunk sums its changes, and
    running sums over blocks of chunks, then within them, give the samples."""
    rows = B.order_fold(feeds.order_messages(spark, sf)).where("last_leg")
    change = F.col("resting") - F.lag("resting", 1, 0).over(Window.partitionBy("locate").orderBy("seq"))
    rows = rows.select(F.ceil(F.col("seq") / SAMPLE_EVERY).cast("long").alias("chunk"), change.alias("change"))
    chunks = rows.groupBy("chunk").agg(F.sum("change").alias("change"))
    return running_sum(chunks, "chunk", "change", "resting").select((F.col("chunk") * SAMPLE_EVERY).alias("seq"), "resting")


_O = "WITH RECURSIVE " + ORDER_FOLD
_BOOK = _O + """, lv AS (
  SELECT seq, leg, locate, side, price, CAST(greatest(0, sum(change) OVER (PARTITION BY locate, side, price ORDER BY seq, leg)) AS BIGINT) AS qty,
         lead(seq * 4 + leg) OVER (PARTITION BY locate, side, price ORDER BY seq, leg) AS until
  FROM legs
), ob AS (
  SELECT m.seq, m.locate, m.ts_ns, coalesce(max(CASE WHEN l.side = 'B' THEN l.price END), 0) AS best_bid, coalesce(min(CASE WHEN l.side = 'S' THEN l.price END), 0) AS best_ask,
         count(CASE WHEN l.side = 'B' THEN 1 END) AS bid_levels, count(CASE WHEN l.side = 'S' THEN 1 END) AS ask_levels
  FROM om m LEFT JOIN lv l ON l.locate = m.locate AND l.seq <= m.seq AND (l.until IS NULL OR l.until > m.seq * 4 + 3) AND l.qty > 0
  GROUP BY m.seq, m.locate, m.ts_ns
)"""
_FLOW = _BOOK + """, ev2 AS (
  SELECT o.seq, o.locate, o.bid_levels > 0 AND o.ask_levels > 0 AS kept, f.trade FROM ob o JOIN fold f ON f.seq = o.seq
), rn AS (
  SELECT seq, kept, list({'t': CAST(coalesce(trade, 0) AS FLOAT), 'c': CAST(CASE WHEN trade IS NULL THEN 0 ELSE 1 END AS FLOAT), 'd': CAST(CASE WHEN kept THEN 0.999 ELSE 1 END AS FLOAT)}) OVER (PARTITION BY locate ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS xs
  FROM ev2
), fl AS (
  SELECT seq, list_reduce(list_prepend({'t': CAST(0 AS FLOAT), 'c': CAST(0 AS FLOAT), 'd': CAST(1 AS FLOAT)}, xs),
    lambda a, x: {'t': CAST(CAST(a.t + x.t AS FLOAT) * x.d AS FLOAT), 'c': CAST(CAST(a.c + x.c AS FLOAT) * x.d AS FLOAT), 'd': x.d}) AS v
  FROM rn WHERE kept
)"""

CATALOG = {
    "order_feed": (order_feed, "WITH " + ORDERS + " SELECT seq, locate, ts_ns, msg_type, ref, CASE WHEN msg_type = 'U' THEN seq END AS new_ref, side, shares, price FROM om"),
    "type_dispatch": (type_dispatch, "WITH " + ORDERS + " SELECT CASE WHEN msg_type IN ('A', 'F') THEN 'add' WHEN msg_type IN ('E', 'C', 'X') THEN 'reduce' WHEN msg_type = 'D' THEN 'delete' ELSE 'replace' END AS action, msg_type, count(*) AS n, CAST(sum(shares) AS BIGINT) AS shares FROM om GROUP BY ALL"),
    "order_fold_status": (order_fold_status, _O + " SELECT f.seq, f.locate, m.msg_type, f.status FROM fold f JOIN om m ON m.seq = f.seq"),
    "order_fold_levels": (order_fold_levels, _BOOK + " SELECT seq, locate, CAST(leg AS BIGINT) AS leg, side, price, qty FROM lv"),
    "order_counters": (order_counters, _O + " SELECT count(*) AS applied, count(CASE WHEN status = 'unknown_ref' THEN 1 END) AS unknown_ref, count(CASE WHEN status = 'bad_reduce' THEN 1 END) AS bad_reduce, count(CASE WHEN added THEN 1 END) - count(CASE WHEN gone THEN 1 END) AS resting, count(DISTINCT locate) AS active FROM fold WHERE seq IS NOT NULL"),
    "run_counters": (run_counters, _BOOK + """, st AS (
  SELECT seq, locate, CASE event_type WHEN 'error' THEN 'H' ELSE 'T' END AS state FROM ev WHERE event_type IN ('error', 'signup')
), j AS (
  SELECT b.*, b.bid_levels > 0 AND b.ask_levels > 0 AS emitted, f.status, f.added, f.gone FROM ob b JOIN fold f ON f.seq = b.seq WHERE b.locate < 100
) SELECT (SELECT count(*) FROM om WHERE locate >= 100) AS bad_locate, (SELECT count(*) FROM om WHERE locate < 100 AND msg_type NOT IN ('A', 'F', 'E', 'C', 'X', 'D', 'U')) AS skipped,
  count(*) AS applied, count(CASE WHEN emitted THEN 1 END) AS emitted, count(CASE WHEN emitted AND ts_ns >= 34200000000000 AND ts_ns < 57600000000000 AND coalesce(s.state, 'T') = 'T' THEN 1 END) AS scored,
  count(CASE WHEN status = 'unknown_ref' THEN 1 END) AS unknown_ref, count(CASE WHEN status = 'bad_reduce' THEN 1 END) AS bad_reduce,
  count(CASE WHEN added THEN 1 END) - count(CASE WHEN gone THEN 1 END) AS resting, count(DISTINCT j.locate) AS active
FROM j ASOF LEFT JOIN st s ON j.locate = s.locate AND j.seq >= s.seq"""),
    "trade_attribution": (trade_attribution, _O + " SELECT seq, locate, trade, CASE WHEN trade > 0 THEN 'S' ELSE 'B' END AS resting_side FROM fold WHERE trade IS NOT NULL"),
    "shared_refs": (shared_refs, "WITH " + ORDERS + " SELECT count(*) AS refs, count(CASE WHEN lo <> hi THEN 1 END) AS shared FROM (SELECT ref, min(locate) AS lo, max(locate) AS hi FROM om WHERE ref >= 0 GROUP BY ref)"),
    "order_book_touch": (order_book_touch, _BOOK + " SELECT seq, best_bid, best_ask, bid_levels, ask_levels FROM ob"),
    "order_profile_mix": (order_profile_mix, _BOOK + ", pv AS (SELECT *, coalesce(lag(qty) OVER (PARTITION BY locate, side, price ORDER BY seq, leg), 0) > 0 AS existed FROM lv) SELECT m.msg_type = 'U' AS replace, CAST(leg AS BIGINT) AS leg, CASE WHEN existed AND qty <> 0 THEN 'modify' WHEN existed THEN 'erase' WHEN qty <> 0 THEN 'insert' ELSE 'none' END AS op, count(*) AS n FROM pv JOIN om m ON m.seq = pv.seq GROUP BY ALL"),
    "peak_orders_sampled": (peak_orders_sampled, _O + " SELECT chunk * 64 AS seq, CAST(sum(change) OVER (ORDER BY chunk) AS BIGINT) AS resting FROM (SELECT CAST(ceil(seq / 64) AS BIGINT) AS chunk, sum(CAST(added AS INTEGER) - CAST(gone AS INTEGER)) AS change FROM fold WHERE seq IS NOT NULL GROUP BY 1)"),
    "feat_decayed_volume": (feat_decayed_volume, _FLOW + " SELECT seq, CAST(CAST(v.t / CAST(1000 AS FLOAT) AS FLOAT) AS DOUBLE) AS signed_vol FROM fl"),
    "feat_trade_rate": (feat_trade_rate, _FLOW + " SELECT seq, CAST(v.c AS DOUBLE) AS trade_rate FROM fl"),
    "served_records": (served_records, _BOOK + """, st AS (
  SELECT seq, locate, CASE event_type WHEN 'error' THEN 'H' ELSE 'T' END AS state FROM ev WHERE event_type IN ('error', 'signup')
) SELECT b.locate, count(*) AS records, min(b.seq) AS first_seq, max(b.seq) AS last_seq FROM ob b ASOF LEFT JOIN st s ON b.locate = s.locate AND b.seq >= s.seq
WHERE bid_levels > 0 AND ask_levels > 0 AND ts_ns >= 34200000000000 AND ts_ns < 57600000000000 AND coalesce(s.state, 'T') = 'T' GROUP BY b.locate"""),
}
