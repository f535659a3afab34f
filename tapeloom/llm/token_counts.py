"""Token counts from an exact histogram of encoded lengths.

One row per distinct length holds all that any context limit asks: how many documents and
tokens there are from that length on. A limit between two lengths reads the next longer one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import staged, table

TOKENIZER = "byte_bpe_50k.tiktoken"
#: Lengths are summed in blocks of so many, then block by block.
BLOCK = 1024

_ENCODERS: dict[str, object] = {}


def encoder(ranks_path: str):
    """One per worker process."""
    if ranks_path not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[ranks_path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[ranks_path]


def encoded_lengths(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``length`` of each text in tokens; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for b in batches:
            n = [len(enc.encode_ordinary(t.as_py() or "")) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["length"])

    return docs.select("text").mapInArrow(run, "length long")


def length_histogram(lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """``lengths(length)`` -> one row per distinct length, with

    docs, tokens: of just that length;
    docs_at_least, tokens_at_least: suffix sums, itself included;
    docs_at_most, quantile: documents up to that length, and their share of all;
    truncated_total: tokens left if every document is cut to that length.

    Sums run inside blocks of lengths and then over the blocks, so no task orders all lengths.
    """
    counts = staged(lengths.groupBy("length").agg(F.count("*").alias("docs")), "lengths")
    rows = counts.select("length", "docs", (F.col("length") * F.col("docs")).alias("tokens"), F.floor(F.col("length") / block).alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row per block of lengths
    every = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("d").over(every).alias("all_docs"),
        F.sum("t").over(every).alias("all_tokens"),
    )
    onward = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({"in_docs": F.sum("docs").over(onward), "in_tokens": F.sum("tokens").over(onward)}).join(blocks, "block")
    docs_from, tokens_from = F.col("in_docs") + F.col("later_docs"), F.col("in_tokens") + F.col("later_tokens")
    at_most = F.col("all_docs") - docs_from + F.col("docs")
    return out.select(
        "length",
        "docs",
        "tokens",
        docs_from.alias("docs_at_least"),
        tokens_from.alias("tokens_at_least"),
        at_most.alias("docs_at_most"),
        (at_most / F.col("all_docs")).alias("quantile"),
        (F.col("all_tokens") - tokens_from + F.col("length") * docs_from).alias("truncated_total"),
    )


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``context_limit, docs_over, tokens_kept, tokens_lost`` for each limit asked for. Every
    value of every limit follows from the histogram, a few numbers to a limit."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    over = F.col("length") > F.col("context_limit")
    kept = F.when(over, F.col("context_limit")).otherwise(F.col("length")) * F.col("docs")
    joined = histogram.join(F.broadcast(asked))  # the limits asked for, a handful
    return joined.groupBy("context_limit").agg(
        F.coalesce(F.sum(F.when(over, F.col("docs"))), F.lit(0)).alias("docs_over"),
        F.coalesce(F.sum(kept), F.lit(0)).alias("tokens_kept"),
        F.coalesce(F.sum(F.col("tokens") - kept), F.lit(0)).alias("tokens_lost"),
    )


def length_at_quantile(histogram: DataFrame, q: float) -> int | None:
    """Smallest length that at least a share ``q`` of all documents doesn't exceed."""
    return histogram.where(F.col("quantile") >= q).agg(F.min("length")).first()[0]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def count_tokens(docs: DataFrame, ranks_path: str, block: int = BLOCK) -> DataFrame:
    """The length histogram of whole texts. Null and empty texts have length 0; repeated rows
    count each time; an empty table gives an empty histogram. Only text is read."""
    return length_histogram(encoded_lengths(docs, ranks_path), block)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), default_ranks())
