"""Shapes of plans that must not creep back: shuffles and folds."""

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import dataset as D
from tapeloom.plans.catalog import CATALOG


@pytest.mark.parametrize("name, exchanges, folds", [("book_top5", 1, 1), ("near_resume_crossings", 2, 1), ("served_records", 3, 1), ("zscore_apply", 2, 0), ("chrono_split", 4, 0), ("peak_levels_sampled", 4, 0)])
def test_shuffles_and_folds(spark, sf, name, exchanges, folds):
    plan = CATALOG[name][0](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= exchanges and plan.count("MapInArrow") == folds


@pytest.mark.parametrize("cells, small", [(3, 2), (4096, 5), (4096, 1 << 16)])
def test_order_statistics_against_sorting(spark, cells, small):
    rows = [(g, v) for g, n in (("a", 700), ("b", 1), (None, 40)) for v in [((i * i * 7919) % 1013) / 8 for i in range(n)]] + [("c", 5.0)] * 9 + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    ranks = {"first": lambda n: F.lit(0), "middle": lambda n: F.floor(n / 2), "last": lambda n: n - 1}
    got = {r.g: (r["first"], r.middle, r["last"], r["_all"]) for r in D.order_statistics(df, "v", ranks, ["g"], cells, small).collect()}
    for g in ("a", "b", "c", None):
        own = sorted(v for k, v in rows if k == g and v is not None)
        assert got[g] == (own[0], own[len(own) // 2], own[-1], len(own))
    assert set(got) == {"a", "b", "c", None}
    whole = D.linear_percentiles(df, "v", {"p10": 0.1, "p99": 0.99}).first()
    import numpy as np

    every = [v for _, v in rows if v is not None]
    assert np.allclose([whole.p10, whole.p99], np.percentile(every, [10, 99]))


def test_selection_with_outliers_and_values_of_all_sizes(spark):
    import math

    values = [i / 7 for i in range(4000)] + [1e300, -1e300, 5e-324, -5e-324, 0.0, -0.0, 1.7e308, float(2**53), float(2**53 + 2)] + [-(2.0 - 2**-52), -2.0, 3.0, math.nextafter(3.0, 4)] * 20
    df = spark.createDataFrame([(x,) for x in [*values, float("nan"), float("inf"), float("-inf"), None]], "v double")
    places = [0, 1, 2, 30, 60, 61, 2000, len(values) - 5, len(values) - 1]
    ranks = {f"r{k}": (lambda n, k=k: F.lit(k)) for k in places}
    got = D.order_statistics(df, "v", ranks, small=3).first()
    assert [got[f"r{k}"] for k in places] == [sorted(values)[k] for k in places] and got["_all"] == len(values)


def test_an_outlier_does_not_press_the_rest_into_one_cell(spark):
    v, n = F.col("v"), 200_000
    df = spark.range(n).select(F.when(F.col("id") == 7, 1e12).otherwise(F.col("id") / 3.0).alias("v"))
    cells = df.groupBy(D._place(v, F.lit(0.0), F.lit(1e12), D.CELLS).alias("cell")).count()
    assert cells.agg(F.max("count")).first()[0] < n / 50
    assert D.order_statistics(df, "v", {"m": lambda k: F.lit(100_000)}, small=100).first().m == 100_001 / 3


def test_running_sum_over_blocks(spark):
    df = spark.range(1000).selectExpr("id * 3 as at", "id % 7 - 3 as step")
    got = {r["at"]: r.total for r in D.running_sum(df, "at", "step", "total", width=50).collect()}
    total = 0
    for i in range(1000):
        total += i % 7 - 3
        assert got[3 * i] == total
