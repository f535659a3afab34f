"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.staging import clean, discard, new_path, shared_dir, staged

__all__ = ["clean", "discard", "held_out", "kept", "new_path", "release", "shared_dir", "staged", "table", "text_or_empty"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from: crc32 of the id as text, mod 5, is 0.
    A null id counts as the empty text, whose remainder is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


_KEPT: dict[str, Any] = {}


def kept(key: str, make: Callable[[], Any]) -> Any:
    """``make()``, kept by a reused worker process for later tasks, one at a time: another key's
    takes its place."""
    if key not in _KEPT:
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Let go of what ``kept`` holds, before work that has no use for it."""
    _KEPT.clear()
