"""Near-duplicates by the exact Jaccard similarity of their sets of word shingles.

Anchors and bands only propose. SimHash fingerprints of the sets meet at their anchors
(``simhash.fingerprint_links``), which finds close copies; at a similarity of 0.8 fingerprints
are too far apart for that, so bands of min-hashes propose texts, too: each text and the first
of each of its buckets. All min-hashes of a set, a byte each, are its sketch, and sketches judge
each proposal. A bucket with a text that is unlike its first is gone through whole, by sketches.
What alike sketches connect is a block; texts that share some of a template meet in buckets, but
make no block. Within a block sets are compared exactly. Buckets and blocks over a bound are
dealt into tiles, and each two tiles are a group of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import discard, staged
from tapeloom.llm.components import connected_components
from tapeloom.llm.grouped import group_bounds, whole_groups
from tapeloom.llm.simhash import fingerprint_links

SHINGLE = 5
MIN_SIMILARITY = 0.8
#: Bits of 64 in which fingerprints of proposed pairs differ at most; anchors reach half of
#: them beyond the covering radius, which is enough to meet.
SIMHASH_BITS = 4
#: A pair at 0.8 shares none of 40 bands of 8 min-hashes with a chance of 0.0007; one at 0.5
#: shares some with 0.15, one at 0.3 with 0.003.
BANDS, ROWS = 40, 8
#: Min-hashes that sort out pairs before their sets are compared, and how many must agree: at
#: 0.8 fewer than 36 of 64 do with a chance below 0.0001.
SKETCH, AGREE = 64, 36
#: Texts and shingles of a tile of a block, and texts of a tile of a bucket.
TILE_TEXTS, TILE_SHINGLES, TILE_SKETCHES = 2_000, 2_000_000, 4_000

_ODD = np.random.default_rng(20).integers(0, 2**63, BANDS * ROWS + SKETCH + SHINGLE, np.uint64) << np.uint64(1) | np.uint64(1)
_BAND, _SKETCH, _WORD = np.split(_ODD, np.cumsum([BANDS * ROWS, SKETCH]))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: A-Z lower-cased, words at ASCII white
    space. A text of fewer words is one shingle, one of no words, or null, has none."""
    import xxhash

    words = text.lower().split() if text else []
    if len(words) < SHINGLE:
        words = [b" ".join(words)] if words else []
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        return mix(h)
    n = len(h) - SHINGLE + 1
    return np.unique(mix(sum(h[k : k + n] * _WORD[k] for k in range(SHINGLE))))


def minima(sets: list[np.ndarray], odd: np.ndarray) -> np.ndarray:
    """(sets, hashes) min-hashes of sets that aren't empty."""
    out = np.zeros((len(sets), len(odd)), np.uint64)
    ends = np.cumsum([len(s) for s in sets])
    part = ends // 32_768  # what a core's cache holds
    for k in np.unique(part):
        own = np.flatnonzero(part == k)
        x = np.concatenate([sets[i] for i in own])
        starts = ends[own] - ends[own[0]] + len(sets[own[0]]) - [len(sets[i]) for i in own]
        for c, a in enumerate(odd):
            out[own, c] = np.minimum.reduceat(x * a, starts)
    return out


def simhash_of(shingles: np.ndarray) -> int:
    """Signed 64-bit SimHash of a set: a bit is set if it is in over half of the hashes."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(shingles)).tobytes(), "little", signed=True)


def parts_of(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches in parts of a few rows, so that the sets of a whole batch are never held at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


#: A row's key: whether its doc_id is null, the doc_id, two hashes of its text and one of all
#: other columns. Rows of one key are the same row.
KEY = ("no_id", "id", "h1", "h2", "h3")
_KEY_SCHEMA = "no_id boolean, id long, h1 long, h2 long, h3 long"


def keyed_rows(docs: DataFrame) -> DataFrame:
    """``docs`` as the columns of ``KEY``, the text in UTF-8, and the whole row as a struct."""
    other = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.xxhash64(F.to_json(F.struct(*other))) if other else F.lit(0).cast("long")
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.isNull().alias("no_id"),
        F.coalesce(doc_id, F.lit(0)).cast("long").alias("id"),
        F.xxhash64("text").alias("h1"),
        F.xxhash64(F.lit(1), "text").alias("h2"),
        rest.alias("h3"),
        F.col("text").cast("binary").alias("text"),
        F.struct("*").alias("row"),
    )


def with_bands(keyed: DataFrame) -> DataFrame:
    """The key and text of rows -> the key, and ``node, n, fp, bands``: a number that equal sets
    share, the set's size, SimHash and band keys. A key is a byte of each min-hash of its band,
    so that the keys are the sketch as well. Whole texts, no shuffle."""
    width = len(KEY)

    def run(batches):
        for b in parts_of(batches):
            sets = [shingle_set(t) for t in b.column(width).to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            node, fp, keys = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.int64), np.zeros(0, np.int64)
            if len(full):
                node[full] = mix(np.array([mix(sets[i] ^ np.uint64(0x5EED)).sum() for i in full], np.uint64))
                fp[full] = [simhash_of(sets[i]) for i in full]
                keys = mix(minima([sets[i] for i in full], _BAND)).astype(np.uint8).ravel().view(np.int64)
            ends = np.concatenate(([0], np.cumsum(np.where(sizes > 0, BANDS, 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(node.view(np.int64)), pa.array(sizes), pa.array(fp), lists], [*KEY, "node", "n", "fp", "bands"])

    return keyed.select(*KEY, "text").mapInArrow(run, f"{_KEY_SCHEMA}, node long, n long, fp long, bands array<long>")


def bucket_firsts(classes: DataFrame) -> DataFrame:
    """``key, node, least``: each node of a bucket of several, but the smallest, with that one."""
    each = classes.select("node", F.explode("bands").alias("key"))
    first = each.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("last")).where("least <> last").select("key", "least")
    return each.join(first, "key").where("node <> least").select("key", "node", "least")


def proposed_pairs(classes: DataFrame, firsts: DataFrame | None = None) -> DataFrame:
    """``classes(node, fp, bands)`` -> ``a, b``: each node with the smallest one of each of its
    bands and of its fingerprint, and the smallest of two fingerprints that meet at an anchor."""
    by_band = (bucket_firsts(classes) if firsts is None else firsts).select(F.col("node").alias("a"), F.col("least").alias("b"))
    # the empty set is a class of its own, whatever its fingerprint
    prints = staged(classes.where("n > 0").groupBy("fp").agg(F.min("node").alias("least")), "set-prints")
    near = fingerprint_links(prints.select("fp"), SIMHASH_BITS, (SIMHASH_BITS + 1) // 2)
    one, two = prints.select(F.col("fp").alias("a"), F.col("least").alias("x")), prints.select(F.col("fp").alias("b"), F.col("least").alias("y"))
    by_anchor = near.join(one, "a").join(two, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = classes.where("n > 0").join(prints, "fp").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    out = staged(by_band.union(by_anchor).union(same).distinct(), "set-proposals")
    discard(prints)
    return out


# ---- sketches ----------------------------------------------------------------------------
def least_agreeing(min_similarity: float) -> int:
    """How many of the min-hashes of a sketch must agree: fewer do, for sets that are just
    similar enough, with a chance below 0.0001."""
    n = BANDS * ROWS
    return int(n * min_similarity - 3.9 * (n * min_similarity * (1 - min_similarity)) ** 0.5)


def sketches_of(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """(rows, min-hashes) bytes of a column of band keys."""
    flat = (lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists).flatten()
    return flat.to_numpy(zero_copy_only=False).view(np.uint8).reshape(len(lists), BANDS * ROWS)


def _sizes_fit(n: np.ndarray, m, min_similarity: float) -> np.ndarray:
    return np.minimum(n, m) >= min_similarity * np.maximum(n, m) - 1e-6


def judged_pairs(pairs: DataFrame, classes: DataFrame, min_similarity: float) -> DataFrame:
    """``a, b, alike`` of each pair: whether sketches and sizes allow the similarity."""
    agreeing = least_agreeing(min_similarity)

    def run(batches):
        for b in batches:
            n, m = b.column(2).to_numpy(), b.column(4).to_numpy()
            same = (sketches_of(b.column(3)) == sketches_of(b.column(5))).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((same >= agreeing) & _sizes_fit(n, m, min_similarity))], ["a", "b", "alike"])

    one = classes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bands").alias("s_a"))
    two = classes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bands").alias("s_b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "s_a", "n_b", "s_b")
    return both.mapInArrow(run, "a long, b long, alike boolean")


def connecting_sketches(sketch: np.ndarray, sizes: np.ndarray, tile: np.ndarray, min_similarity: float) -> list[tuple[int, int]]:
    """Index pairs that connect what pairs of alike sketches connect; where there are two tiles,
    only pairs between them count. As many pairs at most as there are sketches."""
    agreeing, columns = least_agreeing(min_similarity), np.ascontiguousarray(sketch[:, :SKETCH].T)
    first = int(SKETCH * min_similarity - 3.9 * (SKETCH * min_similarity * (1 - min_similarity)) ** 0.5)
    root, across, out = np.arange(len(sketch)), tile.min() != tile.max(), []
    for i in range(len(sketch) - 1):
        may = (root[i + 1 :] != root[i]) & _sizes_fit(sizes[i + 1 :], sizes[i], min_similarity)
        if across:
            may &= tile[i + 1 :] != tile[i]
        # most pairs fall at a part of the sketch, which is laid out by columns
        may &= np.add.reduce(columns[:, i + 1 :] == columns[:, i, None], axis=0, dtype=np.uint8) >= first
        j = np.flatnonzero(may) + i + 1
        for k in j[(sketch[j] == sketch[i]).sum(1) >= agreeing]:
            if root[k] != root[i]:
                out.append((i, int(k)))
                root[root == root[k]] = root[i]
    return out


def alike_in_buckets(classes: DataFrame, each: DataFrame, min_similarity: float, tile_sketches: int) -> DataFrame:
    """``a, b``: links that connect all nodes of alike sketches in each bucket of ``each(key,
    node)``. Sketches are shuffled, not texts; the work of a bucket grows with the square of its
    tiles, the links with its size."""
    tiles = each.groupBy("key").agg(F.ceil(F.count("*") / tile_sketches).cast("int").alias("tiles"))
    dealt = each.join(tiles, "key").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = dealt.join(classes.select("node", "n", "bands"), "node")
    # with another tile each time: every two tiles of a bucket meet once, each with itself too
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("node", "n", "bands", "tile", F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other")).alias("group"))

    def compare(batches):
        for t in whole_groups(batches, "group"):
            node, n, tile, sketch = t.column("node").to_numpy(), t.column("n").to_numpy(), t.column("tile").to_numpy(), sketches_of(t.column("bands"))
            bounds, a, b = group_bounds(t.column("group").to_numpy()), [], []
            for g in np.flatnonzero(np.diff(bounds) > 1):
                own = slice(bounds[g], bounds[g + 1])
                found = connecting_sketches(sketch[own], n[own], tile[own], min_similarity)
                a += [node[own][i] for i, _ in found]
                b += [node[own][k] for _, k in found]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.repartition("group").sortWithinPartitions("group").mapInArrow(compare, "a long, b long")


def alike_links(classes: DataFrame, min_similarity: float = MIN_SIMILARITY, tile_sketches: int = TILE_SKETCHES) -> DataFrame:
    """``classes(node, n, fp, bands)`` -> ``a, b``: links of alike sketches. They connect all
    alike nodes of each bucket: through its first, or, if a node is unlike that, by going
    through the whole bucket."""
    firsts = staged(bucket_firsts(classes), "set-firsts")
    proposed = proposed_pairs(classes, firsts)
    judged = staged(judged_pairs(proposed, classes, min_similarity), "set-judged")
    unlike = judged.where("not alike").select(F.col("a").alias("node"), F.col("b").alias("least"))
    keys = firsts.join(unlike, ["node", "least"], "left_semi").select("key").distinct()
    mixed = staged(classes.select("node", F.explode("bands").alias("key")).join(keys, "key", "left_semi"), "set-mixed")
    discard(firsts, proposed)
    inside = alike_in_buckets(classes, mixed, min_similarity, tile_sketches)
    out = staged(judged.where("alike").select("a", "b").union(inside).distinct(), "set-alike")
    discard(judged, mixed)
    return out


# ---- sets --------------------------------------------------------------------------------
def connecting_pairs(sets: list[np.ndarray], tile: np.ndarray, min_similarity: float) -> list[tuple[int, int]]:
    """Index pairs that connect what pairs of at least ``min_similarity`` connect. Where there
    are two tiles, only pairs between them count. Pairs already connected aren't compared."""
    sizes, sketch = np.array([len(s) for s in sets]), minima(sets, _SKETCH).astype(np.uint32)
    root, across, out = np.arange(len(sets)), len(np.unique(tile)) > 1, []
    for i in range(len(sets)):
        rest = slice(i + 1, None)
        may = (root[rest] != root[i]) & (np.minimum(sizes[rest], sizes[i]) >= min_similarity * np.maximum(sizes[rest], sizes[i]) - 1e-6)
        if across:
            may &= tile[rest] != tile[i]
        j = np.flatnonzero(may) + i + 1
        agree = (sketch[j] == sketch[i]).sum(1)
        j, agree = j[agree >= AGREE], agree[agree >= AGREE]
        for k in j[np.argsort(-agree, kind="stable")]:
            if root[k] == root[i]:
                continue
            common = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
            if common / (sizes[i] + sizes[k] - common) >= min_similarity:
                out.append((i, int(k)))
                root[root == root[k]] = root[i]
    return out


def similar_links(keyed: DataFrame, rows: DataFrame, min_similarity: float = MIN_SIMILARITY, tile_texts: int = TILE_TEXTS, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """``a, b``: nodes whose sets are at least ``min_similarity`` alike, as many links as connect
    them. Texts of blocks, and no others, are read again for their sets."""
    classes = staged(rows.groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands"), F.min(F.struct(*KEY)).alias("row")), "set-classes")
    alike = alike_links(classes, min_similarity)
    blocks = staged(connected_components(alike), "set-blocks")
    members = blocks.join(classes.select("node", "n", "row.*"), "node")
    totals = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / tile_texts), F.ceil(F.sum("n") / tile_shingles)).cast("int").alias("tiles"))
    members = staged(members.join(totals, "root").select(*KEY, "node", "root", "tiles"), "set-members")
    discard(blocks, classes, alike)
    texts = keyed.select(*KEY, "text").join(members, list(KEY)).select("node", "root", "tiles", "text")

    def sets(batches):
        for b in parts_of(batches):
            found = pa.array([shingle_set(t).tobytes() for t in b.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], found], ["node", "root", "tiles", "items"])

    dealt = texts.mapInArrow(sets, "node long, root long, tiles int, items binary").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    # with another tile each time: every two tiles of a block meet once, each with itself too
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("node", "items", "tile", F.xxhash64("root", F.least("tile", "other"), F.greatest("tile", "other")).alias("group"))

    def compare(batches):
        for t in whole_groups(batches, "group"):
            node, tile, items = t.column("node").to_numpy(), t.column("tile").to_numpy(), t.column("items")
            bounds, a, b = group_bounds(t.column("group").to_numpy()), [], []
            for g in np.flatnonzero(np.diff(bounds) > 1):
                own = bounds[g] + np.unique(node[bounds[g] : bounds[g + 1]], return_index=True)[1]
                found = connecting_pairs([np.frombuffer(items[int(i)].as_py(), np.uint64) for i in own], tile[own], min_similarity)
                a += [node[own[i]] for i, _ in found]
                b += [node[own[j]] for _, j in found]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    links = staged(dealt.repartition("group").sortWithinPartitions("group").mapInArrow(compare, "a long, b long"), "set-links")
    discard(members)
    return links


def first_rows(keyed: DataFrame, min_similarity: float = MIN_SIMILARITY, tile_texts: int = TILE_TEXTS, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """The keys of the smallest row of each group that similar texts connect. Texts without
    words are equal."""
    rows = staged(with_bands(keyed), "set-rows")
    links = similar_links(keyed, rows, min_similarity, tile_texts, tile_shingles)
    roots = staged(connected_components(links), "set-roots")
    discard(links)
    named = rows.select(*KEY, "node").join(roots, "node", "left")
    first = staged(named.groupBy(F.coalesce("root", "node").alias("group")).agg(F.min(F.struct(*KEY)).alias("row")).select("row.*"), "set-first")
    discard(rows, roots)
    return first


def keep_first(docs: DataFrame, min_similarity: float = MIN_SIMILARITY, **tiles: int) -> DataFrame:
    """One row, all columns as they are, of each group of ``docs`` that links of an exact
    shingle similarity of at least ``min_similarity`` connect: the one with the smallest doc_id.

    Rows with a null doc_id come after all others, so one of them stays only for a group of
    nothing else. Among rows of one doc_id hashes of the text and of all other columns decide;
    rows that are equal throughout are one. Null texts and texts without words are equal. An
    empty table gives an empty result. Texts are shuffled twice.
    """
    keyed = keyed_rows(docs)
    first = first_rows(keyed, min_similarity, **tiles)
    out = keyed.drop("text").join(first, list(KEY), "left_semi").dropDuplicates(list(KEY))
    return out.select("row.*")
