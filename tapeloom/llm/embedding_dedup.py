"""Near-duplicate embeddings through randomised-rotation binary codes.

A unit vector's code is the signs of its random rotation; it is computed once and stored, with
the correction factor that makes inner-product estimates from the code unbiased. Bits of further rotations deal
vectors to buckets, so that a pair at the threshold meets in at least one of the tables with
the probability asked for. In a bucket, estimates and their confidence bounds tell which pairs
can reach the threshold; only those are recomputed, in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import discard, staged, table
from tapeloom.llm.components import connected_components, local_roots
from tapeloom.llm.grouped import group_bounds, whole_groups

THRESHOLD = 0.95
#: Chance that a pair just at the threshold meets in no table; nearer pairs miss less often.
MISS = 0.001
#: Bits to a code at least, and the half-width of its confidence bounds: in theory's units,
#: where 1.9 is customary; at 4 one pair in ten thousand lies outside.
CODE_BITS = 256
WIDTH = 4.0
#: Vectors that a bucket would hold if all directions were alike.
BUCKET = 32
#: Larger buckets are split into tiles, compared pair by pair of tiles in tasks of their own.
TILE = 2048
SEED = 20240


@lru_cache
def rotations(dim: int, bits: int, seed: int = SEED) -> np.ndarray:
    """(bits, dim): the first ``dim`` columns of random orthogonal matrices, one under the
    other, each as large as a code."""
    side = max(CODE_BITS, -(-dim // 64) * 64)
    rng, blocks = np.random.default_rng(seed), []
    while len(blocks) * side < bits:
        q, r = np.linalg.qr(rng.normal(size=(side, side)))
        blocks.append((q * np.sign(np.diag(r)))[:, :dim])
    return np.concatenate(blocks)[:bits]


def code_bits(dim: int) -> int:
    return max(CODE_BITS, -(-dim // 64) * 64)


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes as -1/1 and their correction factors: the inner product of a rotated vector and
    its code at length one."""
    rotated = unit @ rotations(unit.shape[1], code_bits(unit.shape[1])).T
    return np.where(rotated >= 0, 1.0, -1.0).astype(np.float32), np.abs(rotated).sum(1) / math.sqrt(rotated.shape[1])


def upper_bounds(codes: np.ndarray, factors: np.ndarray, rotated: np.ndarray, width: float = WIDTH) -> np.ndarray:
    """Upper confidence bounds of the inner products of coded vectors with rotated ones."""
    bits = codes.shape[1]
    estimate = (codes @ rotated.T.astype(np.float32)) / (math.sqrt(bits) * factors[:, None])
    return estimate + (width * np.sqrt(np.maximum(0, 1 - factors**2)) / (factors * math.sqrt(bits - 1)))[:, None]


def plan_tables(vectors: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits to a key, tables): keys lengthen with the logarithm of the input so that buckets
    stay small, and tables follow from the chance that a pair at the threshold parts."""
    bits = min(40, max(4, math.ceil(math.log2(max(2, vectors) / BUCKET))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-meet)))


def bucket_keys(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(vectors, tables): each table's number and bits, as one integer."""
    signs = (unit @ rotations(unit.shape[1], bits * tables, SEED + 1).T >= 0).reshape(len(unit), tables, bits)
    return (signs @ (1 << np.arange(bits, dtype=np.int64))) | (np.arange(tables, dtype=np.int64) << 40)


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of one dimension at length one, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of tiny or huge components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pack_codes(codes: np.ndarray) -> pa.Array:
    """Codes of -1/1 as a bit each."""
    bits = np.packbits(codes > 0, axis=1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(bits.shape[1]), len(bits), [None, pa.py_buffer(bits.tobytes())]).cast(pa.binary())


def unpack_codes(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    bits = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.unpackbits(bits, axis=1).astype(np.float32) * 2 - 1


def compare_tile(unit: np.ndarray, codes: np.ndarray, factors: np.ndarray, tile: np.ndarray, a: int, b: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at the threshold or above: all within a tile, or those between two. Rows are
    sorted by id; stored codes stand for the smaller index, or the rows of tile ``a``, and are
    compared with rotations of the others."""
    left, right = (np.arange(len(unit)),) * 2 if a == b else (np.flatnonzero(tile == a), np.flatnonzero(tile == b))
    rotated = unit[right] @ rotations(unit.shape[1], codes.shape[1]).T
    out = []
    for at in range(0, len(left), 512):
        own = left[at : at + 512]
        may = upper_bounds(codes[own], factors[own], rotated) >= threshold
        i, j = np.nonzero(may)
        i, j = own[i], right[j]
        if a == b:
            i, j = i[i < j], j[i < j]
        for part in range(0, len(i), 100_000):
            p, q = i[part : part + 100_000], j[part : part + 100_000]
            ok = np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold
            out.append((p[ok], q[ok]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def vector_links(classes: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, tile: int = TILE) -> DataFrame:
    """``classes(id, copies, embedding)`` of distinct usable vectors -> rows ``kind, x, y``:
    kind 0, that class x is linked to y vectors of other classes; kind 1, a link (x, y) of a
    set that connects what all links connect. Their number grows with the vectors, not with
    the pairs: a pair counts in the first table where it meets, and no pair is a row. (So the
    vector travels with its code: fetching vectors for the pairs that a bound lets through
    would make rows of them.)"""
    bits, tables = plan_tables(classes.count(), threshold, miss)

    def add_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in np.unique(batch.column("dim").to_numpy()):
                b = batch.filter(pa.compute.equal(batch.column("dim"), int(dim)))
                unit = unit_rows(b.column("embedding"))
                codes, factors = encode(unit)
                keys = bucket_keys(unit, bits, tables)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * tables, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, pack_codes(codes), pa.array(factors), lists], [*b.schema.names, "code", "factor", "keys"])

    kind = classes.schema["embedding"].dataType.simpleString()
    sized = classes.select("id", "copies", "embedding", F.size("embedding").alias("dim"))
    keyed = staged(sized.mapInArrow(add_keys, f"id long, copies long, embedding {kind}, dim int, code binary, factor double, keys array<long>"), "keyed")
    each = keyed.select("dim", F.explode("keys").alias("key"))
    large = each.groupBy("dim", "key").count().where(F.col("count") > tile)
    large = staged(large.select("dim", "key", F.ceil(F.col("count") / tile).cast("int").alias("tiles")), "large-buckets")
    rows = keyed.select("id", "copies", "embedding", "dim", "code", "factor", F.explode("keys").alias("key")).join(large, ["dim", "key"], "left")
    rows = rows.withColumn("tile", F.coalesce(F.pmod(F.xxhash64("id"), F.col("tiles")), F.lit(0)).cast("int"))
    # with another tile each time: every two tiles of a bucket meet once, each with itself too
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("tiles"), F.lit(1)) - 1)))
    rows = rows.withColumns({"a": F.least("tile", "other"), "b": F.greatest("tile", "other")})
    rows = rows.select("id", "copies", "embedding", "code", "factor", "key", "tile", "a", "b", F.xxhash64("dim", "key", "a", "b").alias("group"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "group"):
            ids, copies, factor, key, tile_of, a, b, group = (t.column(c).to_numpy() for c in ("id", "copies", "factor", "key", "tile", "a", "b", "group"))
            bounds = group_bounds(group)
            counts, links = [], []
            for g in np.flatnonzero(np.diff(bounds) > 1):
                s = slice(bounds[g], bounds[g + 1])
                unit = unit_rows(t.column("embedding").slice(bounds[g], bounds[g + 1] - bounds[g]))
                codes = unpack_codes(t.column("code").slice(bounds[g], bounds[g + 1] - bounds[g]))
                i, j = compare_tile(unit, codes, factor[s], tile_of[s], a[s.start], b[s.start], threshold)
                if not len(i):
                    continue
                roots = local_roots(len(unit), i, j)
                k = np.flatnonzero(roots != np.arange(len(unit)))
                links.append(np.stack([ids[s][k], ids[s][roots[k]]]))
                used, at = np.unique(np.concatenate((i, j)), return_inverse=True)
                keys = bucket_keys(unit[used], bits, tables)
                for part in range(0, len(i), 20_000):
                    p, q = at[: len(i)][part : part + 20_000], at[len(i) :][part : part + 20_000]
                    same = keys[p] == keys[q]
                    first = same.any(1) & (same.argmax(1) == key[s.start] >> 40)
                    p, q = used[p[first]], used[q[first]]
                    total = np.bincount(p, copies[s][q], len(unit)) + np.bincount(q, copies[s][p], len(unit))
                    k = np.flatnonzero(total)
                    counts.append(np.stack([ids[s][k], total[k].astype(np.int64)]))
            for n, found in enumerate((counts, links)):
                if found:
                    x, y = np.concatenate(found, axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), n, np.int32)), pa.array(x), pa.array(y)], ["kind", "x", "y"])

    dealt = rows.repartition("group").sortWithinPartitions("group", "id")
    return dealt.mapInArrow(compare, "kind int, x long, y long")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row.

    Equal vectors form a class before anything is compared, whose members link to each other
    and share all other links; a vector that a third of all rows repeat is compared once.
    Vectors that are null or zero, or hold null or non-finite components, link with nothing,
    nor do rows with a null vec_id, which aren't kept, or vectors of different dimensions. A vec_id that names
    different vectors is one node. Repeated rows are vectors of their own. An empty table
    gives an empty result. Columns but vec_id and embedding are ignored.
    """
    e = F.col("embedding")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    usable = F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.forall(e, finite) & F.exists(e, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", F.coalesce(usable, F.lit(False)).alias("usable"))
    keyed = rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    named = staged(keyed.select("vec_id", "usable", "h1", "h2"), "vectors")
    classes = keyed.where("usable").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding"))
    classes = staged(classes, "vector-classes")
    links = staged(vector_links(classes.select("id", "copies", "embedding"), threshold, miss, tile), "vector-links")
    roots = staged(connected_components(links.where("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b"))), "vector-roots")
    counts = staged(links.where("kind = 0").groupBy(F.col("x").alias("id")).agg(F.sum("y").alias("others")), "vector-counts")
    result = classes.select("h1", "h2", "id", "copies").join(counts, "id", "left").join(roots, F.col("id") == F.col("node"), "left")
    result = result.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("root", "id").alias("c"))
    result = staged(result, "vector-results")
    discard(classes, links, roots, counts)
    out = named.join(result, ["h1", "h2"], "left")
    component = F.when(F.col("usable"), F.col("c")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("usable"), F.col("n")).otherwise(F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), THRESHOLD)
