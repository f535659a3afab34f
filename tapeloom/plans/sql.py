"""DuckDB text shared by the oracles: the derived feeds, and the book as of each update."""

LEVELS = """
ev AS (
  SELECT event_id AS seq, user_id AS locate, (epoch_us(ts) % 86400000000) * 1000 AS ts_ns, event_type,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) % 40 AS step
  FROM events
), lf AS (
  SELECT seq, locate, ts_ns, event_type, CASE WHEN seq % 2 = 0 THEN 'B' ELSE 'S' END AS side,
         CASE WHEN seq % 2 = 0 THEN 1000000 - 100 * step ELSE 999900 + 100 * step END AS price,
         CASE WHEN k % 5 = 0 THEN 0 ELSE k * 10 END AS qty
  FROM ev
)"""

#: Live levels as of each update, by rank from the touch, and one row per update of it.
BOOK = (
    LEVELS
    + """, iv AS (
  SELECT *, lead(seq) OVER (PARTITION BY locate, side, price ORDER BY seq) AS until FROM lf
), live AS (
  SELECT e.seq, e.locate, i.side, i.price, i.qty,
         row_number() OVER (PARTITION BY e.seq, i.side ORDER BY CASE WHEN i.side = 'B' THEN -i.price ELSE i.price END) AS rk
  FROM lf e JOIN iv i ON i.locate = e.locate AND i.seq <= e.seq AND (i.until IS NULL OR i.until > e.seq) AND i.qty > 0
), bk AS (
  SELECT e.seq, e.locate, e.ts_ns, e.event_type,
         coalesce(max(CASE WHEN l.side = 'B' THEN l.price END), 0) AS best_bid,
         coalesce(min(CASE WHEN l.side = 'S' THEN l.price END), 0) AS best_ask,
         count(CASE WHEN l.side = 'B' THEN 1 END) AS bid_levels, count(CASE WHEN l.side = 'S' THEN 1 END) AS ask_levels,
         CAST(sum(CASE WHEN l.side = 'B' AND rk = 1 THEN l.qty END) AS BIGINT) AS b1, CAST(sum(CASE WHEN l.side = 'S' AND rk = 1 THEN l.qty END) AS BIGINT) AS a1,
         CAST(sum(CASE WHEN l.side = 'B' AND rk <= 3 THEN l.qty END) AS BIGINT) AS b3, CAST(sum(CASE WHEN l.side = 'S' AND rk <= 3 THEN l.qty END) AS BIGINT) AS a3,
         CAST(sum(CASE WHEN l.side = 'B' AND rk <= 5 THEN l.qty END) AS BIGINT) AS b5, CAST(sum(CASE WHEN l.side = 'S' AND rk <= 5 THEN l.qty END) AS BIGINT) AS a5,
         min(CASE WHEN l.side = 'B' AND rk <= 5 THEN l.price END) AS bid_low, max(CASE WHEN l.side = 'S' AND rk <= 5 THEN l.price END) AS ask_high
  FROM lf e LEFT JOIN live l ON l.seq = e.seq GROUP BY ALL
), ft AS (
  SELECT *, best_bid + (best_ask - best_bid) // 2 + CASE WHEN (best_ask - best_bid) < 0 AND (best_ask - best_bid) % 2 <> 0 AND (best_ask - best_bid) // 2 < (best_ask - best_bid) / 2.0 THEN 1 ELSE 0 END AS mid,
         best_ask - best_bid AS spread
  FROM bk WHERE bid_levels > 0 AND ask_levels > 0
)"""
)

STATES = """, st AS (
  SELECT seq, locate, ts_ns, CASE event_type WHEN 'error' THEN 'H' ELSE 'T' END AS state FROM ev WHERE event_type IN ('error', 'signup')
), cr AS (
  SELECT b.*, b.best_bid - b.best_ask AS depth, coalesce(s.state, 'T') AS state, coalesce(s.ts_ns, 0) AS since
  FROM bk b ASOF LEFT JOIN st s ON b.locate = s.locate AND b.seq >= s.seq
  WHERE b.bid_levels > 0 AND b.ask_levels > 0 AND b.best_bid >= b.best_ask
)"""

ORDERS = (
    LEVELS
    + """, om0 AS (
  SELECT seq, locate, ts_ns, k + 1 AS shares, 1000000 + 100 * step AS price, CASE WHEN seq % 3 = 0 THEN 'S' ELSE 'B' END AS side,
         CASE event_type WHEN 'signup' THEN 'A' WHEN 'view' THEN 'F' WHEN 'click' THEN 'X' WHEN 'purchase' THEN 'E' ELSE CASE WHEN seq % 2 = 1 THEN 'U' ELSE 'D' END END AS msg_type
  FROM ev
), om AS (
  SELECT *, CASE WHEN msg_type IN ('A', 'F') THEN seq ELSE coalesce(last_value(CASE WHEN msg_type IN ('A', 'F', 'U') THEN seq END IGNORE NULLS) OVER (PARTITION BY locate ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) END AS ref,
         row_number() OVER (PARTITION BY locate ORDER BY seq) AS n
  FROM om0
)"""
)

#: One message of each symbol per step: only a symbol's last order is ever referred to. ``cut``
#: is what the message takes off the level it names, ``added`` whether it opens an order.
ORDER_FOLD = (
    ORDERS
    + """, fold AS (
  SELECT DISTINCT locate, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, '' AS status, CAST(NULL AS BIGINT) AS trade,
         CAST(-1 AS BIGINT) AS o_ref, CAST(0 AS BIGINT) AS o_left, '' AS o_side, CAST(0 AS BIGINT) AS o_price,
         CAST(0 AS BIGINT) AS cut, '' AS cut_side, CAST(0 AS BIGINT) AS cut_price, false AS added, false AS gone
  FROM om
  UNION ALL
  SELECT locate, n, seq,
    CASE WHEN opens THEN 'ok' WHEN NOT hit THEN 'unknown_ref' WHEN bad THEN 'bad_reduce' ELSE 'ok' END,
    CASE WHEN msg_type = 'E' AND hit THEN CASE WHEN o_side = 'S' THEN shares ELSE -shares END END,
    CASE WHEN opens OR (msg_type = 'U' AND hit) THEN seq WHEN hit AND NOT bad AND take = o_left THEN -1 ELSE o_ref END,
    CASE WHEN opens OR (msg_type = 'U' AND hit) THEN shares WHEN hit AND NOT bad THEN o_left - take ELSE o_left END,
    CASE WHEN opens THEN side ELSE o_side END,
    CASE WHEN opens OR (msg_type = 'U' AND hit) THEN price ELSE o_price END,
    CASE WHEN hit AND NOT bad THEN take ELSE 0 END, o_side, o_price, opens OR (msg_type = 'U' AND hit), hit AND NOT bad AND take = o_left
  FROM (
    SELECT m.locate, m.n, m.seq, m.msg_type, m.shares, m.price, m.side, f.o_ref, f.o_left, f.o_side, f.o_price,
           m.msg_type IN ('A', 'F') AS opens, m.msg_type NOT IN ('A', 'F') AND m.ref >= 0 AND f.o_ref = m.ref AS hit,
           CASE WHEN m.msg_type IN ('D', 'U') THEN f.o_left ELSE m.shares END AS take,
           m.msg_type IN ('E', 'X') AND m.shares > f.o_left AS bad
    FROM fold f JOIN om m ON m.locate = f.locate AND m.n = f.n + 1
  ) x
), legs AS (
  SELECT seq, locate, 1 AS leg, cut_side AS side, cut_price AS price, -cut AS change FROM fold WHERE seq IS NOT NULL AND cut > 0
  UNION ALL
  SELECT seq, locate, CASE WHEN cut > 0 THEN 2 ELSE 1 END, o_side, o_price, o_left FROM fold WHERE seq IS NOT NULL AND added
)"""
)
