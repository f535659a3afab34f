"""Mixing sources to target weights along a time-varying curriculum.

Everything here is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import staged, table

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Sources in code-point order take these weights in turn.
WEIGHTS = (1, 2, 3)
#: A document is taken this many times at most.
MAX_REPEATS = 3
#: Weight of a source over training time 0..1, by its place in WEIGHTS: (time, weight) knots,
#: linear in between. The first fades out, the second is level, the third rises.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
#: Hexadecimal digits of a document's hash that name its chunk within a source.
CHUNK_DIGITS = 3


def invert_schedule(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which a schedule's integral, over its whole, reaches ``share`` (0..1).

    The integral is quadratic between two knots, so its inverse is a square root.
    """
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
    whole = sum(areas)
    if whole <= 0 or min(w for _, w in knots) < 0:
        raise ValueError("a schedule needs weights of 0 or more and a positive integral")
    out, done = None, 0.0
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas, strict=False):
        rest = share * F.lit(whole) - F.lit(done)
        slope = (w1 - w0) / (t1 - t0)
        if slope == 0:
            t = F.lit(t0) + rest / F.lit(w0) if w0 else F.lit(t0)
        else:
            t = F.lit(t0) + (F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0))) - F.lit(w0)) / F.lit(slope)
        done += area
        at = share * F.lit(whole) <= F.lit(done)
        out = F.when(at, t) if out is None else out.when(at, t)
    return F.least(F.greatest(out.otherwise(F.lit(float(knots[-1][0]))), F.lit(float(knots[0][0]))), F.lit(float(knots[-1][0])))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sizes(_source, source, source_size)``, a row per source -> ``place`` and ``target``.

    Targets share the sum of all sizes by weight; one that would exceed ``max_repeats`` times
    its source stops there and the excess is shared again by weight. That settles at
    min(cap, level x weight) for one common level, which the sources in order of cap/weight
    give in one pass. The windows hold a row per source, never one per document.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", w).withColumn("cap", F.col("source_size") * max_repeats)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(onward)
    levels = ranked.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") > F.col("cap"))
    common = F.max(F.when(~F.col("capped"), F.col("level"))).over(every)  # of the first that is not; later ones give less
    target = F.when(F.col("capped") | common.isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), common * F.col("weight")))
    return levels.select("_source", "source_size", "place", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
) -> DataFrame:
    """Which documents a mix takes, how often, and when.

    Per row of ``docs``: doc_id, size, source_size, target, taken, copies, first_position,
    and what ``position`` needs. Within a source, documents stand in the
    order of md5(doc_id), or of their text's where that is null, so reruns agree. A source's cumulative demand runs to its target:
    whole passes first, then one that ends where the target falls, so ``taken`` sums to the
    target (rounded down). The document in which it falls counts the words up to there;
    ``copies`` counts it whole. A document's position inverts the source's integrated schedule
    at the document's cumulative offset.

    Running sums are by chunk: (source, leading digits of the hash) sums rows, a window over
    each source's few thousand chunks gives their offsets, and only a chunk's rows are sorted
    together; a source with a third of all rows is dealt over all its chunks.

    Null text and white space give size 0, which takes nothing. A null source is a source of
    its own. Repeated rows and doc_ids are rows of their own.
    An empty table gives an empty result. Columns not named here are ignored.
    """
    rows = staged(_sized(docs).select("doc_id", "source", "size", "_order", "_source", "_chunk"), "mix-rows")
    return _positions(rows, weights, max_repeats, schedules)


def _sized(docs: DataFrame) -> DataFrame:
    """``docs`` as a struct, with what decides a row's place and size."""
    by_text = F.concat(F.lit("#"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), by_text).cast("binary"))
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("_order"), F.xxhash64("text").alias("_text"), F.struct("*").alias("_row"))
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # never null, so that window and join share one shuffle
    return rows.withColumns({"_source": named, "_chunk": F.substring("_order", 1, CHUNK_DIGITS)})


def _positions(rows, weights, max_repeats, schedules, carried=()):
    chunks = staged(rows.groupBy("_source", "_chunk").agg(F.sum("size").alias("chunk_size"), F.min("source").alias("source")), "mix-chunks")
    sources = chunks.groupBy("_source").agg(F.sum("chunk_size").alias("source_size"), F.min("source").alias("source"))
    targets = source_targets(sources, weights, max_repeats)
    along = Window.partitionBy("_source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = chunks.select("_source", "_chunk", F.coalesce(F.sum("chunk_size").over(along), F.lit(0)).alias("chunk_start")).join(targets, "_source")
    order = ["_order", F.col("doc_id").asc_nulls_first(), "size", *[c for c in ("_text",) if c in carried]]
    inside = Window.partitionBy("_source", "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["_source", "_chunk"])
    start = F.col("chunk_start") + F.col("_inside")
    whole = F.floor(F.col("target")).cast("long")
    passes = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    rest = whole - passes * F.col("source_size") - start
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest))
    placed = placed.withColumn("_start", start).withColumn("_passes", passes).withColumn("_part", part)
    placed = placed.withColumn("taken", F.col("_passes") * F.col("size") + F.col("_part"))
    placed = placed.withColumn("copies", F.when(F.col("size") > 0, F.col("_passes") + (F.col("_part") > 0).cast("long")).otherwise(F.lit(0)))
    placed = placed.withColumn("first_position", F.when(F.col("copies") > 0, position(F.col("_start"), schedules)))
    return placed.select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "first_position", "_start", "place", *carried)


def position(offset: Column, schedules=SCHEDULES) -> Column:
    """Training time 0..1 of a word offset in its source's demand (columns target, place)."""
    share = F.when(F.col("target") > 0, offset.cast("double") / F.col("target")).otherwise(F.lit(0.0))
    out = F.lit(None).cast("double")
    for i, knots in enumerate(schedules):
        out = F.when(F.col("place") % len(schedules) == i, invert_schedule(share, knots)).otherwise(out)
    return out


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, schedules=SCHEDULES) -> DataFrame:
    """Every row of ``docs`` as often as the mix takes it, whole, range-sorted by training
    position, with all columns as they are. Rows are placed as ``mix`` places them: repeated
    rows and doc_ids are rows of their own, those with a null doc_id too; documents without a
    word are not taken. Texts go with their rows through the shuffle that numbers them."""
    placed = _positions(_sized(docs), weights, max_repeats, schedules, ("_order", "_text", "_row"))
    each = placed.where("copies > 0").select("*", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("_pass"))
    each = each.withColumn("_position", position(F.col("_start") + F.col("_pass") * F.col("source_size"), schedules))
    return each.orderBy("_position", "_order", "_text", "_pass").select("_row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents at production weights, range-sorted by their first training position."""
    out = mix(table(spark, sf_dir, "documents")).orderBy("first_position", "doc_id")
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "first_position")


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '#' || md5(coalesce(text, '')))) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place
  FROM w GROUP BY source
), r AS (
  SELECT *, place % 3 + 1 AS weight, source_size * 3 AS cap FROM s
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM r
), c AS (
  SELECT *, level * weight > cap AS capped, max(CASE WHEN level * weight <= cap THEN level END) OVER () AS common FROM l
), t AS (
  SELECT source, source_size, place,
         CASE WHEN capped OR common IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), common * weight) END AS target
  FROM c
), p AS (
  SELECT w.doc_id, w.size, t.source_size, t.target, t.place,
         CAST(coalesce(sum(w.size) OVER (PARTITION BY w.source ORDER BY k, w.doc_id NULLS FIRST, w.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM w JOIN t ON w.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS passes FROM p
), u AS (
  SELECT *, greatest(0, least(size, CAST(floor(target) AS BIGINT) - passes * source_size - start)) AS part,
         CASE WHEN target > 0 THEN CAST(start AS DOUBLE) / target ELSE 0.0 END AS share
  FROM q
), v AS (
  SELECT *, CASE WHEN size > 0 THEN passes + CAST(part > 0 AS BIGINT) ELSE 0 END AS copies FROM u
)
SELECT doc_id, size, source_size, target, CAST(passes * size + part AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies,
       CASE WHEN copies > 0 THEN least(greatest(CASE place % 3
         WHEN 0 THEN 0.0::DOUBLE + (sqrt(greatest(2.25::DOUBLE + -2.0::DOUBLE * (share * 1.0::DOUBLE - 0.0::DOUBLE), 0.0::DOUBLE)) - 1.5::DOUBLE) / -1.0::DOUBLE
         WHEN 1 THEN 0.0::DOUBLE + (share * 1.0::DOUBLE - 0.0::DOUBLE) / 1.0::DOUBLE
         ELSE CASE WHEN share * 1.0::DOUBLE <= 0.375::DOUBLE
              THEN 0.0::DOUBLE + (sqrt(greatest(0.25::DOUBLE + 2.0::DOUBLE * (share * 1.0::DOUBLE - 0.0::DOUBLE), 0.0::DOUBLE)) - 0.5::DOUBLE) / 1.0::DOUBLE
              ELSE 0.5::DOUBLE + (sqrt(greatest(1.0::DOUBLE + 2.0::DOUBLE * (share * 1.0::DOUBLE - 0.375::DOUBLE), 0.0::DOUBLE)) - 1.0::DOUBLE) / 1.0::DOUBLE END
         END, 0.0::DOUBLE), 1.0::DOUBLE) END AS first_position
FROM v
"""
