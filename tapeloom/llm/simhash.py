"""SimHash near-duplicates by anchor-point covering.

A fingerprint's two 23-bit blocks are covered by the binary Golay code, whose covering radius
is 3 and which is perfect: each block value lies within 3 bits of one codeword. Anchors are
pairs of codewords. A fingerprint goes to every anchor within the covering radius plus the
threshold, so that the anchor that covers one fingerprint holds all that are near it.

``spare`` says how far beyond the covering radius both sides go. Half of the threshold is
enough, too: for two fingerprints within t bits there is a value within t/2 bits of both, whose
anchor lies within the covering radius plus t/2 of both. That refinement finds the same links
with a sixth of the copies; the threshold itself is the default.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import discard, staged, table
from tapeloom.llm.components import connected_components, local_roots
from tapeloom.llm.grouped import group_bounds, whole_groups

#: Words to a shingle, and bits in which linked fingerprints may differ.
SHINGLE = 3
MAX_BITS = 2
SEED = 42
BLOCK = 23
RADIUS = 3
#: Generator polynomial of the [23,12] Golay code: x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101
#: Groups over this size are compared through shared midpoints rather than pair by pair.
DIRECT = 64


# ---- fingerprints ------------------------------------------------------------------------
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text: A-Z lower-cased, split at ASCII white space,
    shingles counted with repeats; a bit is set if it is in over half of their XXH64 hashes.
    A text of fewer words is one shingle; one of no words, or null, has fingerprint 0."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digests = np.frombuffer(b"".join([xxhash.xxh64_digest(p, SEED) for p in parts]), np.uint8).reshape(-1, 8)
    seen = np.bincount((digests + (np.arange(8) << 8)).ravel(), minlength=2048).reshape(8, 256)
    return int.from_bytes(np.packbits((seen @ _BITS).ravel() * 2 > len(digests)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long. Whole texts; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


# ---- anchors -----------------------------------------------------------------------------
@lru_cache
def syndrome_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainder of a block value modulo the generator, by each of its three bytes."""
    out = []
    for shift in (0, 8, 16):
        t = np.zeros(256, np.uint32)
        for v in range(256):
            r = v << shift
            for bit in range(BLOCK, 10, -1):
                if r >> bit & 1:
                    r ^= GOLAY << (bit - 11)
            t[v] = r
        out.append(t)
    return tuple(out)


def syndrome(x: np.ndarray) -> np.ndarray:
    a, b, c = syndrome_tables()
    return a[x & 255] ^ b[(x >> 8) & 255] ^ c[(x >> 16) & 255]


@lru_cache
def errors_within(radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Error patterns of at most ``radius`` bits, sorted by syndrome, and where each of the
    2,048 syndromes starts: x ^ e is a codeword for just the patterns of x's syndrome."""
    patterns = np.array([sum(1 << i for i in c) for w in range(radius + 1) for c in combinations(range(BLOCK), w)], np.uint32)
    s = syndrome(patterns)
    order = np.argsort(s, kind="stable")
    return patterns[order], np.searchsorted(s[order], np.arange(2049))


def codewords_within(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into x, codeword) for every codeword within ``radius`` bits of each value."""
    patterns, starts = errors_within(radius)
    s = syndrome(x)
    n = starts[s + 1] - starts[s]
    index = np.repeat(np.arange(len(x)), n)
    at = np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[s], n)
    return index, x[index] ^ patterns[at]


def anchors_of(fp: np.ndarray, spare: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(index into fp, anchor) for every anchor within the covering radius plus ``spare`` bits,
    which the two blocks may share in any way."""
    x = fp.view(np.uint64)
    high, low = (x & np.uint64(2**BLOCK - 1)).astype(np.uint32), ((x >> np.uint64(BLOCK)) & np.uint64(2**BLOCK - 1)).astype(np.uint32)
    parts = []
    for extra in range(spare + 1):
        i, a = codewords_within(high, RADIUS + extra)
        k, b = codewords_within(low[i], RADIUS + spare - extra)
        parts.append(np.stack([i[k], (a[k].astype(np.int64) << BLOCK) | b.astype(np.int64)]))
    index, anchor = np.concatenate(parts, axis=1)
    if spare:  # an anchor found with several shares of the spare bits
        order = np.lexsort((anchor, index))
        index, anchor = index[order], anchor[order]
        new = np.concatenate(([True], (index[1:] != index[:-1]) | (anchor[1:] != anchor[:-1]))) if len(index) else np.zeros(0, bool)
        index, anchor = index[new], anchor[new]
    return index, anchor


# ---- links -------------------------------------------------------------------------------
def links_within(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect what the distinct values of one large group link, in a number
    that grows with the group and not with its square for up to 2 bits: values within 2 bits
    share a midpoint. Beyond 2 bits, blocks of rows are compared with all others."""
    if max_bits > 2:
        found = [np.zeros((2, 0), np.int64)]
        for at in range(0, len(fp), 512):
            near = np.bitwise_count(fp[at : at + 512, None] ^ fp[None, :]) <= max_bits
            i, j = np.nonzero(near)
            new = i + at < j
            roots = local_roots(len(fp), i[new] + at, j[new])
            k = np.flatnonzero(roots != np.arange(len(fp)))
            found.append(np.stack([k, roots[k]]))
        pairs = np.concatenate(found, axis=1)
        return pairs[0], pairs[1]
    flips = np.concatenate(([np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)))
    if max_bits == 0:
        flips = flips[:1]
    slices = max(1, len(fp) * len(flips) // 4_000_000)
    out_i, out_j = [], []
    for part in range(slices):
        mids, owner = [], []
        for f in flips:
            m = fp ^ f
            use = np.flatnonzero((m * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(slices) == part)
            mids.append(m[use])
            owner.append(use)
        m, o = np.concatenate(mids), np.concatenate(owner)
        order = np.argsort(m, kind="stable")
        m, o = m[order], o[order]
        same = np.flatnonzero(m[1:] == m[:-1])
        if max_bits == 1:  # a shared midpoint that is neither of the two would be 2 bits
            ok = np.bitwise_count(fp[o[same]] ^ fp[o[same + 1]]) <= 1
            same = same[ok]
        out_i.append(o[same])
        out_j.append(o[same + 1])
    return np.concatenate(out_i), np.concatenate(out_j)


def spanning_links(anchor: np.ndarray, fp: np.ndarray, max_bits: int) -> np.ndarray:
    """Links (a, b) of fingerprints that connect just what is within ``max_bits`` at a shared
    anchor; rows are sorted by anchor and hold whole groups. At most one per fingerprint."""
    x = fp.view(np.uint64)
    bounds = group_bounds(anchor)
    sizes = np.diff(bounds)
    left, right = [], []
    small = np.repeat(sizes <= DIRECT, sizes)
    rows = np.flatnonzero(small & np.repeat(sizes > 1, sizes))
    for k in range(1, DIRECT):
        rows = rows[rows + k < len(fp)]
        rows = rows[anchor[rows] == anchor[rows + k]]
        if not len(rows):
            break
        hit = rows[np.bitwise_count(x[rows] ^ x[rows + k]) <= max_bits]
        left.append(hit)
        right.append(hit + k)
    for g in np.flatnonzero(sizes > DIRECT):
        at = bounds[g]
        i, j = links_within(x[at : bounds[g + 1]], max_bits)
        left.append(i + at)
        right.append(j + at)
    if not left or not sum(map(len, left)):
        return np.zeros((2, 0), np.int64)
    values, index = np.unique(fp, return_inverse=True)
    roots = local_roots(len(values), index[np.concatenate(left)], index[np.concatenate(right)])
    k = np.flatnonzero(roots != np.arange(len(values)))
    return np.stack([values[k], values[roots[k]]])


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, spare: int | None = None) -> DataFrame:
    """``fp`` (distinct) -> ``a, b``: links whose closure is that of all pairs within
    ``max_bits``. One shuffle, of some sixty (anchor, fp) pairs to a fingerprint at 2 bits, or
    ten with a ``spare`` of 1; links are lost below half of ``max_bits``, which is refused."""
    spare = max_bits if spare is None else spare
    if 2 * spare < max_bits:
        raise ValueError("anchors must reach at least half of the threshold beyond the covering radius")

    def replicate(batches):
        for b in batches:
            every = b.column(0).to_numpy()
            for at in range(0, len(every), 4096):
                fp = every[at : at + 4096]
                index, anchor = anchors_of(fp, spare)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[index])], ["anchor", "fp"])

    def compare(batches):
        for t in whole_groups(batches, "anchor"):
            a, b = spanning_links(t.column("anchor").to_numpy(), t.column("fp").to_numpy(), max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    copies = fps.select("fp").mapInArrow(replicate, "anchor long, fp long")
    dealt = copies.repartition("anchor").sortWithinPartitions("anchor", "fp")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, spare: int | None = None) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs``.

    component_id is the smallest doc_id that links of at most ``max_bits`` bits reach. Equal
    fingerprints are one class before anything is compared, so a group of copies of any size
    is a single fingerprint in the search; documents and classes meet again in one join whose
    hot keys AQE splits.

    Null and empty texts, and those of white space only, have fingerprint 0 and link like any
    other. Repeated rows and doc_ids give repeated results. Null doc_ids are kept; a component
    of nothing else has a null component_id. An empty table gives an empty result. Columns
    but doc_id and text are ignored.
    """
    rows = staged(with_fingerprints(docs, shingle), "fingerprints")
    classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = staged(connected_components(fingerprint_links(classes, max_bits, spare)), "roots")
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = staged(rooted, "rooted")
    first = staged(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "first")
    named = staged(rooted.join(first, "root").select("fp", "component_id"), "named")
    discard(classes, roots, rooted, first)
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), SHINGLE, MAX_BITS)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
