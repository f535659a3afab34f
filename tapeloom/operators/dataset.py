"""From feature records to training data: filters, labels, splits, statistics, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import market as m
from tapeloom.staging import staged


def training_rows(records: DataFrame, max_spread: int = m.MAX_SPREAD) -> DataFrame:
    """Rows in market hours whose book is neither locked nor crossed nor too wide."""
    return records.where(m.in_hours(F.col("ts_ns")) & (F.col("spread") > 0) & (F.col("spread") <= max_spread))


def horizon_labels(records: DataFrame, horizon: int = m.HORIZON, threshold: int = m.THRESHOLD, key: str = "locate") -> DataFrame:
    """Adds ``label``: 0, 1, 2 as the middle price ``horizon`` rows on is lower, about the
    same or higher; rows without such a future go."""
    if horizon <= 0:
        raise ValueError("a horizon is one row or more")
    delta = F.lead("mid", horizon).over(Window.partitionBy(key).orderBy("seq")) - F.col("mid")
    out = records.withColumn("_delta", delta).where("_delta is not null")
    return out.withColumn("label", F.when(F.col("_delta") < -threshold, 0).when(F.col("_delta") > threshold, 2).otherwise(1)).drop("_delta")


def numbered(rows: DataFrame, order: str, width: int = 1 << 20) -> DataFrame:
    """Adds ``row_no``, from 0, in the order of a whole-number column, and ``row_count``. Rows
    are staged once and numbered in ranges of the column; the ranges' counts give each its
    start and the whole its count: no task sorts all rows."""
    rows = staged(rows.withColumn("_range", F.floor(F.col(order) / width).cast("long")), "numbered")
    counts = rows.groupBy("_range").count()
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = counts.select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"), F.sum("count").over(Window.partitionBy()).alias("row_count"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    out = rows.withColumn("_n", inside).join(starts, "_range")
    return out.withColumn("row_no", F.col("_start") + F.col("_n")).drop("_range", "_n", "_start")


def running_sum(rows: DataFrame, order: str, value: str, name: str, width: int = 1 << 16) -> DataFrame:
    """``order`` and the sum of ``value`` up to it, of rows with distinct whole numbers
    ``order``: block by block, then within blocks, so that no task orders all rows."""
    rows = staged(rows.select(order, value, F.floor(F.col(order) / width).cast("long").alias("_block")), "running")
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    blocks = rows.groupBy("_block").agg(F.sum(value).alias("_sum")).select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = F.sum(value).over(Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_inside", inside).join(blocks, "_block").select(order, (F.col("_start") + F.col("_inside")).alias(name))


def chrono_split(rows: DataFrame, order: str = "seq", train: float = 0.7, val: float = 0.15, width: int = 1 << 20) -> DataFrame:
    """Adds ``split``: the first share of rows trains, the next validates, the rest tests."""
    n, number = F.col("row_count"), F.col("row_no")
    split = F.when(number < F.floor(n * F.lit(train)), "train").when(number < F.floor(n * F.lit(train + val)), "val").otherwise("test")
    return numbered(rows, order, width).withColumn("split", split).drop("row_count", "row_no")


def zscore_stats(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean and population deviation of each column; a deviation of 0 becomes 1."""
    stats = []
    for c in columns:
        sd = F.stddev_pop(F.col(c).cast("double"))
        stats += [F.avg(F.col(c).cast("double")).alias(f"{c}_mean"), F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias(f"{c}_std")]
    return rows.agg(*stats)


def zscore_apply(rows: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = rows.crossJoin(F.broadcast(stats))  # one row
    scaled = {c: ((F.col(c).cast("double") - F.col(f"{c}_mean")) / F.col(f"{c}_std")).cast("float") for c in columns}
    return out.withColumns(scaled).drop(*stats.columns)


#: Values of an interval from which on it is cut into cells, and cells of a cut.
SMALL, CELLS = 1 << 16, 4096


def _place(v: Column, lo: Column, hi: Column, cells: int) -> Column:
    """The cell of a value between ``lo`` and ``hi``, a rising function of it. Ends of one sign and
    within a factor of four are cut in equal steps; all others by the logarithm of their size, 64
    cells to a power of two, so that a few far values don't press the rest into one cell."""
    wider = F.when(F.abs(hi) >= F.abs(lo), hi).otherwise(lo)  # quotients by it are exact enough to tell ends apart, and never overflow
    a, b = F.try_divide(lo, wider), F.try_divide(hi, wider)
    near = (F.signum(lo) == F.signum(hi)) & (F.least(F.abs(a), F.abs(b)) >= 0.25)
    step = F.floor(F.try_divide(F.try_divide(v, wider) - a, b - a) * cells)
    size = F.when(v == 0, F.lit(0)).otherwise(F.floor(F.log2(F.abs(v)) * 64) + 68_800)  # from 2^-1074 on, counted from above 0
    return F.when(hi <= lo, F.lit(0)).when(near, F.least(F.greatest(step, F.lit(0)), F.lit(cells - 1))).otherwise(F.signum(v) * size).cast("int")


def order_statistics(rows: DataFrame, value: str, ranks: dict[str, Callable[[Column], Column]], by: Sequence[str] = (), cells: int = CELLS, small: int = SMALL) -> DataFrame:
    """The value at given positions, from 0, of each group's sorted values, exactly; ``ranks``
    makes positions of a group's count. Nulls and what isn't finite are no values.

    Exact selection by descent: the interval in which a position falls is cut into cells, whose
    counts say in which of them it goes on, until the interval holds few values or one. Only
    those few are put in order. Rows are staged once; no task holds a group, however its values
    lie.
    """
    key = F.to_json(F.struct(*by)) if by else F.lit("")
    v = F.col("_v").cast("double")
    finite = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value).cast("double")) != F.lit(float("inf")))
    rows = staged(rows.where(finite).select(*by, key.alias("_g"), F.col(value).alias("_v")), "values")
    groups = rows.groupBy("_g").agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count("*").alias("_all"), *[F.first(c).alias(c) for c in by])
    groups = staged(groups, "groups")
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("_all")).cast("long").alias("k")) for name, rank in ranks.items()]))
    asked = groups.select("_g", "lo", "hi", F.col("_all").alias("n"), each.alias("_ask")).select("_g", "_ask.name", "_ask.k", "lo", "hi", "n").where("k >= 0 and k < n")
    done = []
    while True:
        asked = staged(asked, "asked")
        wide = (F.col("n") > small) & (F.col("lo") < F.col("hi"))
        done.append(asked.where(~wide))
        asked = asked.where(wide)
        if asked.isEmpty():
            break
        spans = asked.select("_g", "lo", "hi").distinct()  # positions in one interval descend together
        inside = rows.join(spans, "_g").where((v >= F.col("lo")) & (v <= F.col("hi")))
        counts = inside.groupBy("_g", "lo", "hi", _place(v, F.col("lo"), F.col("hi"), cells).alias("cell")).agg(F.count("*").alias("m"), F.min(v).alias("first"), F.max(v).alias("last"))
        upto = Window.partitionBy("_g", "lo", "hi").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)  # cells of a cut
        counts = counts.withColumn("to", F.sum("m").over(upto))
        found = asked.join(counts, ["_g", "lo", "hi"]).where((F.col("k") < F.col("to")) & (F.col("k") >= F.col("to") - F.col("m")))
        asked = found.select("_g", "name", (F.col("k") - (F.col("to") - F.col("m"))).alias("k"), F.col("first").alias("lo"), F.col("last").alias("hi"), F.col("m").alias("n"))
    asked = reduce(DataFrame.unionAll, done)
    spans = asked.select("_g", "lo", "hi").distinct()
    values = rows.join(spans, "_g").where((v >= F.col("lo")) & (v <= F.col("hi"))).groupBy("_g", "lo", "hi", "_v").count()  # equal values are one row
    inside = Window.partitionBy("_g", "lo", "hi").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("to", F.sum("count").over(inside))
    found = values.join(asked, ["_g", "lo", "hi"]).where((F.col("k") < F.col("to")) & (F.col("k") >= F.col("to") - F.col("count")))
    picked = found.groupBy("_g").agg(*[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in ranks])
    return groups.select("_g", "_all", *by).join(picked, "_g").drop("_g")


def nearest_lower_percentiles(rows: DataFrame, value: str, quantiles: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """The sorted value at position floor(p x (n-1)) of each group, exactly."""
    ranks = {name: lambda n, p=p: F.floor(F.lit(p) * (n - 1)) for name, p in quantiles.items()}
    return order_statistics(rows, value, ranks, by).drop("_all")


def linear_percentiles(rows: DataFrame, value: str, quantiles: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Percentiles of each group with linear steps between the two nearest values, exactly."""
    at = lambda n, p: F.lit(float(p)) * (n - 1)
    ranks = {f"{name}_{side}": lambda n, p=p, cut=cut: cut(at(n, p)) for name, p in quantiles.items() for side, cut in (("lo", F.floor), ("hi", F.ceil))}
    found = order_statistics(rows, value, ranks, by)
    out = []
    for name, p in quantiles.items():
        lo, hi = F.col(f"{name}_lo").cast("double"), F.col(f"{name}_hi").cast("double")
        out.append((lo + (hi - lo) * (at(F.col("_all"), p) - F.floor(at(F.col("_all"), p)))).alias(name))
    return found.select(*by, *out)


def log2_histogram(rows: DataFrame, value: Column) -> DataFrame:
    """Per power-of-two bucket: its bounds, count, share and cumulative share."""
    b = rows.select(m.log2_bucket(value).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    total, upto = F.sum("n").over(Window.partitionBy()), F.sum("n").over(Window.orderBy("bucket"))  # 40 rows at most
    power = F.pow(F.lit(2.0), F.col("bucket")).cast("long")
    return b.select("bucket", F.when(F.col("bucket") == 0, 0).otherwise((power / 2).cast("long")).alias("low"), (power - 1).alias("high"), "n", (F.col("n") / total).alias("share"), (upto / total).alias("cumulative"), upto.alias("upto"), total.alias("total"))


def log2_percentile(histogram: DataFrame, p: float) -> Column:
    """Upper bound of the first bucket that the share ``p`` of all values reaches."""
    return F.min(F.when(F.col("upto") >= F.floor(F.lit(p) * F.col("total")), F.col("high")))


def confusion(rows: DataFrame, label: str = "y", pred: str = "pred") -> DataFrame:
    return rows.groupBy(label).pivot(pred, [0, 1, 2]).count().na.fill(0)


def recalls(rows: DataFrame, label: str = "y", pred: str = "pred", classes: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Recall of every class; NaN for one that doesn't occur."""
    spark = rows.sparkSession
    hits = rows.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"), F.count_if(F.col(label) == F.col(pred)).alias("hits"))
    every = spark.createDataFrame([(c,) for c in classes], "class int")
    out = every.join(hits, "class", "left").na.fill(0, ["n", "hits"])
    return out.withColumn("recall", F.when(F.col("n") == 0, F.lit(float("nan"))).otherwise(F.col("hits") / F.greatest(F.col("n"), F.lit(1))))


def majority(rows: DataFrame, label: str = "y") -> DataFrame:
    """The most frequent class, the lowest of equals."""
    return rows.groupBy(label).count().agg(F.max_by(label, F.struct("count", -F.col(label))).alias("class"))


def feature_summary(rows: DataFrame, values: str = "f") -> DataFrame:
    """Per position of an array column: range, linear percentiles, and what isn't finite."""
    each = rows.select(F.posexplode(values).alias("feature", "v")).withColumn("v", F.col("v").cast("double"))
    ok = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != F.lit(float("inf")))
    bad = each.groupBy("feature").agg(F.count_if(~ok).alias("bad"))
    points = linear_percentiles(each.where(ok), "v", {"low": 0.0, "p1": 0.01, "p50": 0.5, "p99": 0.99, "high": 1.0}, ["feature"])
    return bad.join(points, "feature", "left")


def difference(a: DataFrame, b: DataFrame, key: str = "id", values: str = "logits") -> DataFrame:
    """How two scorings of the same rows differ: largest and mean gap, largest relative gap, the
    row with the largest gap (the first of equals), rows whose class differs, and rows that are
    equal throughout."""
    both = a.select(key, F.col(values).alias("x")).join(b.select(key, F.col(values).alias("y")), key)
    gaps = F.transform(F.arrays_zip("x", "y"), lambda p: F.abs(p["x"].cast("double") - p["y"].cast("double")))
    scale = F.array_max(F.transform("x", lambda v: F.abs(v.cast("double"))))
    rows = both.select(F.col(key).alias("key"), F.array_max(gaps).alias("gap"), F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g).alias("total"), scale.alias("scale"), (m.first_argmax(F.col("x")) != m.first_argmax(F.col("y"))).alias("other"), F.size("x").alias("k"))
    return rows.agg(
        F.count("*").alias("n"),
        F.max("gap").alias("max_gap"),
        (F.sum("total") / F.sum("k")).alias("mean_gap"),
        F.max(F.col("gap") / F.greatest(F.col("scale"), F.lit(1e-12))).alias("max_relative"),
        F.max_by("key", F.struct("gap", -F.col("key"))).alias("worst_row"),
        F.count_if(F.col("other")).alias("class_changes"),
        F.count_if(F.col("gap") == 0).alias("equal_rows"),
    )
