"""Sharding by longest-processing-time scheduling of groups that must stay together.

Groups of one size are interchangeable, so what the heap schedules is the histogram of their
sizes: each size in turn, largest first, deals its groups to the least-loaded shards. Groups
then find their shard by their rank within their size. Every group meets the heap, and shards
end with the loads that a heap over single groups gives.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import discard, staged, table, text_or_empty

SHARDS = 24
#: Bytes that a document costs besides its text.
OVERHEAD = 8
#: Parts in which the rows of a shard, and the groups of a size, are numbered.
CHUNKS = 64


class Shards:
    """Loads by shard, and a heap of them: of equal loads the smaller number comes first."""

    def __init__(self, shards: int):
        self.heap = [(0, s) for s in range(shards)]

    def deal(self, size: int, n: int) -> np.ndarray:
        """How many of ``n`` jobs of one size each shard takes, largest-first scheduling being
        at that size. Far more jobs than shards are dealt in rounds: while the fullest shard
        lies within reach, all shards can be filled to a common level at once."""
        taken = np.zeros(len(self.heap), np.int64)
        if size <= 0:
            taken[self.heap[0][1]] = n
            return taken
        if n > 4 * len(taken):
            loads = np.zeros(len(taken), np.int64)
            for load, shard in self.heap:
                loads[shard] = load
            # jobs that start below a level: the heap deals all of those before any at or
            # above it, whatever their order; the highest level that asks for at most n
            low, high = int(loads.min()), int(loads.max()) + size * n
            started = lambda level: np.maximum(0, -((loads - level) // size))
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if started(middle).sum() <= n else (low, middle)
            taken = started(low).astype(np.int64)
            self.heap = [(int(loads[s] + size * taken[s]), s) for s in range(len(taken))]
            heapq.heapify(self.heap)
            n -= int(taken.sum())
        for _ in range(n):
            load, shard = self.heap[0]
            heapq.heapreplace(self.heap, (load + size, shard))
            taken[shard] += 1
        return taken


def schedule_sizes(histogram: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``histogram(bytes, jobs)``, a row per distinct size -> ``bytes, ends, shards``: the jobs
    of a size with a rank below the first end go to the first shard, and so on.

    One task runs the heap over batches in descending order of size and keeps nothing but the
    loads. It reads a row per distinct size: fewer than the square root of twice the total
    bytes, and no more than the longest text has bytes, plus one per larger group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap = Shards(shards)
        for b in batches:
            ends, names = [], []
            for size, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                taken = heap.deal(size, n)
                used = np.flatnonzero(taken)
                ends.append(np.cumsum(taken[used]).tolist())
                names.append(used.tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ends, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.int32()))], ["bytes", "ends", "shards"])

    ordered = histogram.select("bytes", "jobs").repartition(1).sortWithinPartitions(F.col("bytes").desc())
    return ordered.mapInArrow(run, "bytes long, ends array<long>, shards array<int>")


def shard_groups(rows: DataFrame, shards: int = SHARDS, chunks: int = CHUNKS) -> DataFrame:
    """``rows(group, size)`` -> ``group, shard``, one row per distinct group, sizes near equal:
    longest processing time over all groups. Shards end within one group of each other, unless
    a single group is larger than a shard. Ranks within a size are counted by (size, chunk of
    the hashed group), so that a common size is dealt out."""
    groups = staged(
        rows.groupBy("group").agg(F.sum("size").alias("bytes")).withColumn("chunk", F.pmod(F.xxhash64("group"), F.lit(chunks)).cast("int")),
        "groups",
    )
    counts = staged(groups.groupBy("bytes", "chunk").agg(F.count("*").alias("n")), "size-counts")
    dealt = staged(schedule_sizes(counts.groupBy("bytes").agg(F.sum("n").alias("jobs")), shards), "dealt")
    along = Window.partitionBy("bytes").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # chunks of a size
    starts = counts.select("bytes", "chunk", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("start")).join(dealt, "bytes")
    inside = F.row_number().over(Window.partitionBy("bytes", "chunk").orderBy("group"))
    ranked = groups.withColumn("_n", inside).join(starts, ["bytes", "chunk"]).withColumn("rank", F.col("start") + F.col("_n") - 1)
    before = F.size(F.filter("ends", lambda e: e <= F.col("rank")))
    out = staged(ranked.select("group", F.element_at("shards", before + 1).alias("shard")), "group-shards")
    discard(groups, counts, dealt)
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS, chunks: int = CHUNKS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for each row of ``docs``.

    Equal texts form a group and share a shard; null counts as the empty text. size is the
    text's UTF-8 bytes plus 8. Slots number a shard's rows from 0 without gaps: rows are
    numbered within (shard, chunk of the hashed row), and the counts of those give each
    chunk its start, so no task holds a shard. Repeated rows and doc_ids have slots of their
    own, in no given order among equals. An empty table gives an empty result. Columns but
    doc_id and text are ignored.
    """
    text = text_or_empty()
    rows = staged(
        docs.select(
            "doc_id",
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("group"),
        ),
        "sizes",
    )
    homes = shard_groups(rows, shards, chunks)
    placed = rows.join(homes, "group").select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(chunks)).cast("int").alias("chunk"))
    placed = staged(placed, "placed")
    discard(rows, homes)
    counts = placed.groupBy("shard", "chunk").count()
    along = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "chunk", F.coalesce(F.sum("count").over(along), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32"))
    # broadcast: shards x chunks rows
    out = placed.withColumn("_n", inside).join(F.broadcast(starts), ["shard", "chunk"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("_n") - 1).alias("slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
