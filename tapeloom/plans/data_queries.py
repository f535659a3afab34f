"""Queries of the dataset operators: filters, labels, splits, percentiles, histograms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.functions import market as m
from tapeloom.operators import book as B
from tapeloom.operators import dataset as D
from tapeloom.plans.sql import BOOK
from tapeloom.sources import feeds
from tapeloom.staging import staged

HORIZON = 5
QUANTILES = {"p50": 0.5, "p99": 0.99, "p999": 0.999, "largest": 1.0}


def _records(spark, sf):
    return B.stateless_features(B.books(feeds.level_updates(spark, sf))).select("seq", "locate", "ts_ns", "mid", "spread", "imb1", "imb5")


def _training(spark, sf):
    return D.training_rows(_records(spark, sf))


def training_filter(spark, sf):
    return _training(spark, sf).select("seq", "mid", "spread")


def horizon_labels(spark, sf):
    return D.horizon_labels(_training(spark, sf), HORIZON).select("seq", "locate", "label")


def chrono_split(spark, sf):
    return D.chrono_split(_training(spark, sf)).select("seq", "split")


def _train(spark, sf):
    return D.chrono_split(_training(spark, sf)).where("split = 'train'")


def zscore_stats(spark, sf):
    s = D.zscore_stats(_train(spark, sf), ["mid", "spread"])
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


def zscore_apply(spark, sf):
    rows = staged(D.chrono_split(_training(spark, sf).select("seq", "spread")), "split-rows")
    stats = D.zscore_stats(rows.where("split = 'train'"), ["spread"])
    out = D.zscore_apply(rows.where("split <> 'train'").select("seq", "spread"), stats, ["spread"])
    return out.select("seq", F.round(F.col("spread").cast("double"), 4).alias("z"))


def _classes(spark, sf):
    e = feeds.table(spark, sf, "embeddings")
    pred = m.first_argmax(F.slice("embedding", 1, 3))
    return e.select("vec_id", (F.col("label") % 3).alias("y"), pred.alias("pred"))


def class_distribution(spark, sf):
    counts = _classes(spark, sf).groupBy("y").agg(F.count("*").alias("n"))
    return counts.select("y", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9).alias("share"))


def majority_baseline(spark, sf):
    rows = _classes(spark, sf)
    return rows.crossJoin(F.broadcast(D.majority(rows))).agg(F.first("class").alias("class"), F.round(F.count_if(F.col("y") == F.col("class")) / F.count("*"), 9).alias("accuracy"))  # one row


def confusion(spark, sf):
    c = D.confusion(_classes(spark, sf))
    return c.select("y", *[F.col(str(k)).alias(f"pred_{k}") for k in range(3)])


def per_class_recall(spark, sf):
    r = D.recalls(_classes(spark, sf))
    return r.select("class", "n", "hits", F.round("recall", 9).alias("recall"))


def pct_nearest_lower(spark, sf):
    return D.nearest_lower_percentiles(feeds.table(spark, sf, "lineitem"), "l_extendedprice", QUANTILES, ["l_returnflag"])


def pct_linear(spark, sf):
    p = {"p1": 0.01, "p50": 0.5, "p99": 0.99, "p9999": 0.9999}
    out = D.linear_percentiles(feeds.table(spark, sf, "lineitem"), "l_extendedprice", p, ["l_returnflag"])
    return out.select("l_returnflag", *[F.round(n, 6).alias(n) for n in p])


def log2_histogram(spark, sf):
    h = D.log2_histogram(feeds.table(spark, sf, "lineitem"), F.floor("l_extendedprice").cast("long"))
    return h.select("bucket", F.col("low").cast("long").alias("low"), "high", "n", F.round("share", 9).alias("share"), F.round("cumulative", 9).alias("cumulative"))


def log2_pct(spark, sf):
    h = D.log2_histogram(feeds.table(spark, sf, "lineitem"), F.floor("l_extendedprice").cast("long"))
    return h.agg(*[D.log2_percentile(h, p).alias(n) for n, p in {"p50": 0.5, "p90": 0.9, "p99": 0.99}.items()])


def feature_summary(spark, sf):
    s = D.feature_summary(feeds.table(spark, sf, "embeddings").select(F.slice("embedding", 1, 16).alias("f")))
    return s.select("feature", *[F.round(c, 6).alias(c) for c in ("low", "p1", "p50", "p99", "high")], "bad")


def finite_check(spark, sf):
    """Locked books give features without a value: count them by feature."""
    f = B.stateless_features(B.books(feeds.level_updates(spark, sf)))
    names = ("microdev", "bid_slope", "ask_slope", "imb1")
    return f.agg(F.count("*").alias("rows"), *[F.count_if(F.col(n).isNull() | F.isnan(n)).alias(n) for n in names])


def feature_ranges(spark, sf):
    """Invariants: imbalances within -1..1, fills within .2..1."""
    f = B.stateless_features(B.books(feeds.level_updates(spark, sf)))
    bad = [F.count_if(~F.col(c).between(-1, 1)).alias(c) for c in ("imb1", "imb3", "imb5")] + [F.count_if(~F.col(c).between(F.lit(0.2).cast("float"), F.lit(1.0))).alias(c) for c in ("bid_fill", "ask_fill")]
    return f.agg(*bad)


_W = "WITH RECURSIVE " + BOOK
_T = _W + ", tr AS (SELECT * FROM ft WHERE ts_ns >= 34200000000000 AND ts_ns < 57600000000000 AND spread > 0 AND spread <= 2200)"
_S = _T + ", sp AS (SELECT *, CASE WHEN r < floor(n * 0.7::DOUBLE) THEN 'train' WHEN r < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS r, count(*) OVER () AS n FROM tr))"
_C = "WITH c AS (SELECT vec_id, label % 3 AS y, CAST(list_position(embedding[1:3], list_max(embedding[1:3])) - 1 AS INTEGER) AS pred FROM embeddings)"
_H = "WITH h AS (SELECT CASE WHEN v = 0 THEN 0 ELSE least(length(bin(v)), 39) END AS bucket, count(*) AS n FROM (SELECT CAST(floor(l_extendedprice) AS BIGINT) AS v FROM lineitem) GROUP BY 1), g AS (SELECT *, sum(n) OVER (ORDER BY bucket) AS upto, sum(n) OVER () AS total FROM h)"

CATALOG = {
    "training_filter": (training_filter, _T + " SELECT seq, mid, spread FROM tr"),
    "horizon_labels": (horizon_labels, _T + f" SELECT seq, locate, CAST(CASE WHEN d < -50 THEN 0 WHEN d > 50 THEN 2 ELSE 1 END AS INTEGER) AS label FROM (SELECT *, lead(mid, {HORIZON}) OVER (PARTITION BY locate ORDER BY seq) - mid AS d FROM tr) WHERE d IS NOT NULL"),
    "chrono_split": (chrono_split, _S + " SELECT seq, split FROM sp"),
    "zscore_stats": (zscore_stats, _S + " SELECT " + ", ".join(f"round(avg(CAST({c} AS DOUBLE)), 6) AS {c}_mean, round(CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END, 6) AS {c}_std" for c in ("mid", "spread")) + " FROM sp WHERE split = 'train'"),
    "zscore_apply": (zscore_apply, _S + " SELECT seq, round(CAST(CAST((spread - m) / s AS FLOAT) AS DOUBLE), 4) AS z FROM sp, (SELECT avg(CAST(spread AS DOUBLE)) AS m, CASE WHEN stddev_pop(spread) = 0 THEN 1 ELSE stddev_pop(spread) END AS s FROM sp WHERE split = 'train') WHERE split <> 'train'"),
    "class_distribution": (class_distribution, _C + " SELECT y, count(*) AS n, round(count(*) / (SELECT count(*) FROM c), 9) AS share FROM c GROUP BY y"),
    "majority_baseline": (majority_baseline, _C + ", j AS (SELECT y FROM c GROUP BY y ORDER BY count(*) DESC, y LIMIT 1) SELECT j.y AS class, round(count(CASE WHEN c.y = j.y THEN 1 END) / count(*), 9) AS accuracy FROM c, j GROUP BY j.y"),
    "confusion": (confusion, _C + " SELECT y, " + ", ".join(f"count(CASE WHEN pred = {k} THEN 1 END) AS pred_{k}" for k in range(3)) + " FROM c GROUP BY y"),
    "per_class_recall": (per_class_recall, _C + " SELECT CAST(k.class AS INTEGER) AS class, count(c.y) AS n, count(CASE WHEN y = pred THEN 1 END) AS hits, round(CASE WHEN count(c.y) = 0 THEN 'nan'::DOUBLE ELSE count(CASE WHEN y = pred THEN 1 END) / count(c.y) END, 9) AS recall FROM (SELECT unnest([0, 1, 2]) AS class) k LEFT JOIN c ON c.y = k.class GROUP BY k.class"),
    "pct_nearest_lower": (pct_nearest_lower, "SELECT l_returnflag, " + ", ".join(f"l[1 + CAST(floor({p}::DOUBLE * (len(l) - 1)) AS BIGINT)] AS {n}" for n, p in QUANTILES.items()) + " FROM (SELECT l_returnflag, list(l_extendedprice ORDER BY l_extendedprice) AS l FROM lineitem GROUP BY l_returnflag)"),
    "pct_linear": (pct_linear, "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 6) AS {n}" for n, q in {"p1": 0.01, "p50": 0.5, "p99": 0.99, "p9999": 0.9999}.items()) + " FROM lineitem GROUP BY l_returnflag"),
    "log2_histogram": (log2_histogram, _H + " SELECT CAST(bucket AS INTEGER) AS bucket, CASE WHEN bucket = 0 THEN 0 ELSE CAST(2 ** (bucket - 1) AS BIGINT) END AS low, CAST(2 ** bucket AS BIGINT) - 1 AS high, n, round(n / total, 9) AS share, round(upto / total, 9) AS cumulative FROM g"),
    "log2_pct": (log2_pct, _H + " SELECT " + ", ".join(f"min(CASE WHEN upto >= floor({p}::DOUBLE * total) THEN CAST(2 ** bucket AS BIGINT) - 1 END) AS {n}" for n, p in {"p50": 0.5, "p90": 0.9, "p99": 0.99}.items()) + " FROM g"),
    "feature_summary": (feature_summary, "SELECT CAST(i - 1 AS INTEGER) AS feature, round(min(v), 6) AS low, round(quantile_cont(v, 0.01), 6) AS p1, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.99), 6) AS p99, round(max(v), 6) AS high, count(CASE WHEN NOT isfinite(v) THEN 1 END) AS bad FROM (SELECT unnest(range(1, 17)) AS i, unnest(CAST(embedding[1:16] AS DOUBLE[])) AS v FROM embeddings) GROUP BY 1"),
    "finite_check": (finite_check, _W + " SELECT count(*) AS rows, count(CASE WHEN spread = 0 THEN 1 END) AS microdev, count(CASE WHEN spread = 0 THEN 1 END) AS bid_slope, count(CASE WHEN spread = 0 THEN 1 END) AS ask_slope, CAST(0 AS BIGINT) AS imb1 FROM ft"),
    "feature_ranges": (feature_ranges, _W + " SELECT " + ", ".join(f"count(CASE WHEN abs((b{k} - a{k}) / (b{k} + a{k})) > 1 THEN 1 END) AS imb{k}" for k in (1, 3, 5)) + ", count(CASE WHEN bid_levels < 1 THEN 1 END) AS bid_fill, count(CASE WHEN ask_levels < 1 THEN 1 END) AS ask_fill FROM ft"),
}
