"""Level and order feeds derived from the ``events`` table.

The test data have no market feed; these projections give one with all that the operators
need. They read three or four columns of events and shuffle nothing, but for the reference of
an order message, which is the last earlier order of the same user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions.market import ns_of_day


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    step = F.floor("value").cast("long") % 40
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("locate"), ns_of_day(F.col("ts")).alias("ts_ns"), "event_type", k.alias("k"), step.alias("step")
    )


def level_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, locate, ts_ns, event_type, side, price, qty``: absolute quantities, 0 removes."""
    even = F.col("seq") % 2 == 0
    return _base(spark, sf_dir).select(
        "seq",
        "locate",
        "ts_ns",
        "event_type",
        F.when(even, "B").otherwise("S").alias("side"),
        F.when(even, 1_000_000 - 100 * F.col("step")).otherwise(999_900 + 100 * F.col("step")).alias("price"),
        F.when(F.col("k") % 5 == 0, F.lit(0)).otherwise(F.col("k") * 10).cast("long").alias("qty"),
    )


def order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, locate, ts_ns, msg_type, ref, new_ref, side, shares, price``."""
    odd = F.col("seq") % 2 == 1
    kind = (
        F.when(F.col("event_type") == "signup", "A")
        .when(F.col("event_type") == "view", "F")
        .when(F.col("event_type") == "click", "X")
        .when(F.col("event_type") == "purchase", "E")
        .when(odd, "U")
        .otherwise("D")
    )
    rows = _base(spark, sf_dir).withColumn("msg_type", kind)
    opens = F.when(F.col("msg_type").isin("A", "F", "U"), F.col("seq"))
    earlier = Window.partitionBy("locate").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(F.last(opens, ignorenulls=True).over(earlier), F.lit(-1))
    return rows.select(
        "seq",
        "locate",
        "ts_ns",
        "msg_type",
        F.when(F.col("msg_type").isin("A", "F"), F.col("seq")).otherwise(last).alias("ref"),
        F.when(F.col("msg_type") == "U", F.col("seq")).alias("new_ref"),
        F.when(F.col("seq") % 3 == 0, "S").otherwise("B").alias("side"),
        (F.col("k") + 1).alias("shares"),
        (1_000_000 + 100 * F.col("step")).alias("price"),
    )


def trading_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, locate, ts_ns, state``: errors halt a user's symbol, signups resume it."""
    rows = _base(spark, sf_dir).where(F.col("event_type").isin("error", "signup"))
    return rows.select("seq", "locate", "ts_ns", F.when(F.col("event_type") == "error", "H").otherwise("T").alias("state"))
