"""Intermediate tables in the folder that the driver and all executors see."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _qualified(spark: SparkSession, base: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs, fs.makeQualified(path)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the session's warehouse where that isn't set. On a cluster the
    warehouse must not be a local folder, of which each machine has its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = _qualified(spark, base or spark.conf.get("spark.sql.warehouse.dir"))[1].toString().rstrip("/")
    if not base and path.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{path} isn't shared between machines: set spark.checkpoint.dir")
    return path


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tapeloom-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage ends there,
    so a lost executor costs a read, and what uses it twice doesn't compute it twice."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tapeloom_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    fs, qualified = _qualified(spark, path)
    fs.delete(qualified, True)


def discard(*frames: DataFrame) -> None:
    """Delete what ``staged`` wrote once nothing will read it again."""
    for df in frames:
        path = getattr(df, "_tapeloom_path", None)
        if path:
            _delete(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Delete all that this application has staged, once its results have been read."""
    _delete(spark, _own_dir(spark))
