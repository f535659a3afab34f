"""Merkle manifest of a table of documents: a ternary tree per source, and one over their roots.

Leaves are numbered within their source, and whole blocks of them are reduced apart, each to
one node. The few nodes that blocks leave are the top of the tree: the driver builds it and
broadcasts what a block's proofs have in common, their suffix from the block's node up to the
root. Executors put the suffix behind the part inside the block, and fold each row.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import discard, staged, table

ARITY = 3
#: Levels that a block of leaves is reduced through: 3 to the power of 7 leaves a block.
LEVELS = 7
#: Nodes from which the driver builds the top of a tree; more are reduced in blocks once more.
TOP_NODES = 20_000
SIZE = 32


# ---- nodes -------------------------------------------------------------------------------
def digest(nodes: bytes) -> bytes:
    """SHA-256 of digests side by side, as hex text."""
    return sha256(nodes.hex().encode()).digest()


def levels_of(nodes: bytes, levels: int | None = None) -> list[bytes]:
    """All levels of a tree from its lowest up; ``levels`` of them at most, or, if that is
    None, up to the root. A last run that is short, even of one, becomes its digest too."""
    out, run = [nodes], ARITY * SIZE
    while len(out[-1]) > SIZE if levels is None else len(out) <= levels:
        below = out[-1]
        out.append(b"".join([digest(below[at : at + run]) for at in range(0, len(below), run)]))
    return out


def _others(level: bytes, i: int) -> bytes:
    first = i - i % ARITY
    return level[first * SIZE : i * SIZE] + level[(i + 1) * SIZE : (first + ARITY) * SIZE]


def paths(levels: list[bytes]) -> Iterator[bytes]:
    """The siblings of each node of the lowest level on its way up, side by side."""
    above = [b""] * (len(levels[-1]) // SIZE)
    for level in reversed(levels[1:-1]):
        above = [_others(level, i) + above[i // ARITY] for i in range(len(level) // SIZE)]
    lowest = levels[0]
    for i in range(len(lowest) // SIZE):
        yield _others(lowest, i) + above[i // ARITY] if len(levels) > 1 else b""


def fold(leaf: bytes, path: bytes, places: list[tuple[int, int]]) -> bytes:
    """The root that ``leaf`` and its siblings give. ``places``: position and count of the
    leaf's tree, then those of each tree above, whose node the tree's root is."""
    at = 0
    for i, n in places:
        while n > 1:
            first = i - i % ARITY
            others = (min(ARITY, n - first) - 1) * SIZE
            left = at + (i - first) * SIZE
            leaf = digest(path[at:left] + leaf + path[left : at + others])
            at, i, n = at + others, i // ARITY, -(-n // ARITY)
    return leaf


# ---- positions ---------------------------------------------------------------------------
def positions(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows``, which are staged, with their position within their tree from 0, its count of
    rows and the rank of the tree among all, ordered by ``tree`` and ``order``.

    Rows are dealt by ranges of both, equal ones too, and numbered within ranges; the counts of
    the ranges give each its start. No task holds a tree.
    """
    placed = staged(rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(tree, *order, "_row").withColumn("_part", F.spark_partition_id()), "ranges")
    counts = staged(placed.groupBy(tree, "_part").agg(F.count("*").alias("n"), F.lit(1).alias("one")), "range-counts")
    along = Window.partitionBy(tree).orderBy("_part")
    starts = counts.select(
        tree,
        "_part",
        F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
        F.sum("n").over(Window.partitionBy(tree)).alias("count"),
    )
    # trees before a tree: those that end in earlier ranges, and earlier ones of its first range
    firsts = counts.groupBy(tree).agg(F.min("_part").alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_first").orderBy(tree)) - 1
    before = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = firsts.groupBy("_first").agg(F.count("*").alias("_trees")).select("_first", F.coalesce(F.sum("_trees").over(before), F.lit(0)).alias("_offset"))
    ranks = firsts.withColumn("_inside", inside).join(offsets, "_first").select(tree, (F.col("_offset") + F.col("_inside")).alias("rank"))
    number = F.row_number().over(Window.partitionBy(tree, "_part").orderBy(*order)) - 1
    out = placed.withColumn("_n", number).join(starts.join(ranks, tree), [tree, "_part"])
    return out.withColumn("pos", F.col("_start") + F.col("_n")).drop("_row", "_part", "_n", "_start")


# ---- trees -------------------------------------------------------------------------------
def _blocks(batches: Iterator[pa.RecordBatch], leaves: int) -> Iterator[pa.Table]:
    """Whole blocks of a partition sorted by tree and position: one starts where the position
    is a multiple of a block's leaves."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        starts = [i for i, pos in enumerate(b.column("pos").to_pylist()) if pos % leaves == 0]
        for lo, hi in zip([0, *starts], [*starts, b.num_rows], strict=True):
            if held and lo in starts:
                yield pa.Table.from_batches(held)
                held = []
            if hi > lo:
                held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _levels(block: pa.Table, levels: int) -> list[bytes]:
    """Of a block. A tree that is one block ends with its root, all others with the block's node."""
    whole = block.column("count")[0].as_py() <= ARITY**levels
    return levels_of(b"".join(block.column("digest").to_pylist()), None if whole else levels)


def _by_block(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / ARITY**levels)).repartition("rank", "block").sortWithinPartitions("rank", "block", "pos")


def block_nodes(nodes: DataFrame, levels: int) -> DataFrame:
    """``nodes(rank, pos, count, digest)`` -> the same columns of the nodes that blocks leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, ARITY**levels):
            rank, pos, count, _ = (block.column(c)[0].as_py() for c in ("rank", "pos", "count", "digest"))
            row = rank, pos // ARITY**levels, -(-count // ARITY**levels), _levels(block, levels)[-1]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["rank", "pos", "count", "digest"])

    return _by_block(nodes.select("rank", "pos", "count", "digest"), levels).mapInArrow(run, "rank long, pos long, count long, digest binary")


def block_paths(nodes: DataFrame, levels: int) -> DataFrame:
    """``nodes`` with their ``block`` and their siblings below the block's node, ``inner``."""
    ordered = _by_block(nodes, levels)
    names = ordered.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, ARITY**levels):
            yield from block.append_column("inner", pa.array(paths(_levels(block, levels)), pa.binary())).to_batches()

    return ordered.mapInArrow(run, ordered.select(*names, F.lit(b"").alias("inner")).schema)


def _top(nodes: DataFrame) -> DataFrame:
    """Paths and roots of ``TOP_NODES`` nodes or fewer, built on the driver."""
    spark, trees = nodes.sparkSession, {}
    for r in nodes.orderBy("rank", "pos").toLocalIterator():
        trees.setdefault(r.rank, []).append(bytes(r.digest))
    rows = []
    for rank, digests in trees.items():
        levels = levels_of(b"".join(digests))
        rows += [(rank, i, bytearray(p), bytearray(levels[-1])) for i, p in enumerate(paths(levels))]
    return spark.createDataFrame(rows, "rank long, pos long, path binary, root binary")


def proofs(nodes: DataFrame, levels: int, top: int) -> tuple[DataFrame, bool]:
    """``rank, pos, path, root`` per row of ``nodes(rank, pos, count, digest)``, and whether
    these rows are at most ``top`` and come from the driver. More are reduced by blocks, until
    what is left of trees with more than one node is that small."""
    if nodes.count() <= top:
        return _top(nodes), True
    left = staged(block_nodes(nodes, levels), "block-nodes")
    done = left.where("count = 1").select("rank", "pos", F.lit(b"").alias("path"), F.col("digest").alias("root"))
    upper, _ = proofs(left.where("count > 1"), levels, top)
    above = done.unionAll(upper).select("rank", F.col("pos").alias("block"), F.col("path").alias("outer"), "root")
    inner = block_paths(nodes.select("rank", "pos", "count", "digest"), levels)
    return inner.join(above, ["rank", "block"]).select("rank", "pos", F.concat("inner", "outer").alias("path"), "root"), False


# ---- documents ---------------------------------------------------------------------------
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(*fields: Column) -> Column:
    """Hex SHA-256 of fields, each by its length in bytes and its value, or ``-`` if null."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def manifest(docs: DataFrame, received: Column, levels: int = LEVELS, top: int = TOP_NODES) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, its ``leaf``, its source's ``subroot``, the ``root``, its
    ``siblings`` from the leaf up (binary, 32 bytes each), and ``folded_root``, which the leaf of
    the text as ``received``, a column of ``docs``, gives with those siblings.

    Leaves stand in the order of doc_id, null first, equal ids in that of their leaf. Sources
    stand bytewise, null, which is a source of its own, first. Repeated rows have a leaf each;
    nulls, empty and long texts are fields like any other. A table of one row has its leaf as
    root and no siblings; an empty one gives an empty result. Columns but ``FIELDS`` are ignored.
    """
    fields = [F.col(c) for c in FIELDS]
    rows = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("tree"),  # null first
        F.unhex(leaf_of(*fields)).alias("digest"),
        F.unhex(leaf_of(*fields[:-1], received)).alias("received"),
    )
    rows = staged(rows.withColumn("received", F.when(F.col("received") != F.col("digest"), F.col("received"))), "leaves")
    leaves = staged(positions(rows, "tree", ["doc_id", "digest"]).drop("tree"), "numbered-leaves")
    discard(rows)
    nodes = staged(block_nodes(leaves, levels), "block-nodes")
    above, small = proofs(nodes, levels, top)
    above = above.select("rank", F.col("pos").alias("block"), F.col("path").alias("outer"), F.col("root").alias("subroot"))
    above = above if small else staged(above, "suffixes")
    subroots = above.select("rank", "subroot").distinct() if small else above.where("block = 0").select("rank", "subroot")
    subroots = staged(subroots, "subroots")
    sources = subroots.count()
    roots, few = proofs(subroots.select(F.lit(0).cast("long").alias("rank"), F.col("rank").alias("pos"), F.lit(sources).cast("long").alias("count"), F.col("subroot").alias("digest")), levels, top)
    suffixes = above.join(F.broadcast(roots) if few else roots, above["rank"] == roots["pos"]).select(above["rank"], "block", F.concat("outer", "path").alias("outer"), "subroot", "root")
    inner = block_paths(leaves, levels)
    joined = inner.join(F.broadcast(suffixes) if small else suffixes, ["rank", "block"])  # at most ``top`` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            folded = []
            for leaf, path, pos, count, rank in zip(*(b.column(c).to_pylist() for c in ("read", "siblings", "pos", "count", "rank")), strict=True):
                folded.append(fold(leaf, path, [(pos, count), (rank, sources)]))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "leaf", "subroot", "root", "siblings")], pa.array(folded, pa.binary())], ["doc_id", "leaf", "subroot", "root", "siblings", "folded_root"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = joined.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.concat("inner", "outer").alias("siblings"), F.coalesce("received", "digest").alias("read"), "pos", "count", "rank")
    return joined.mapInArrow(run, f"doc_id {kind}, leaf binary, subroot binary, root binary, siblings binary, folded_root binary")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    touched = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    out = manifest(docs, F.when(touched, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select(
        "doc_id",
        text("leaf"),
        text("subroot"),
        text("root"),
        F.sha2(F.lower(F.hex("siblings")).cast("binary"), 256).alias("proof_sha256"),
        text("folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _field(column: str) -> str:
    return f"coalesce(strlen(({column})::VARCHAR)::VARCHAR || ':' || ({column})::VARCHAR, '-')"


#: crc32 of short texts, bit by bit, as DuckDB has none.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"""

OP12_SQL = f"""
WITH RECURSIVE read_docs AS (
    SELECT *, CASE WHEN xor({_CRC}, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS received FROM documents
), leaves AS (
    SELECT row_number() OVER () AS id, doc_id, source,
           sha256({" || ".join(map(_field, FIELDS))}) AS leaf,
           sha256({" || ".join(map(_field, [*FIELDS[:-1], "received"]))}) AS read_leaf
    FROM read_docs
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
           count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS rank
    FROM leaves
), nodes AS (
    SELECT rank, 0 AS level, pos, leaf AS digest, n FROM placed
    UNION ALL
    SELECT rank, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 2) // 3)
    FROM nodes WHERE n > 1 GROUP BY rank, level, pos // 3
), subroots AS (
    SELECT rank, digest FROM nodes WHERE n = 1
), upper_nodes AS (
    SELECT 1000 AS level, rank AS pos, digest, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 2) // 3)
    FROM upper_nodes WHERE n > 1 GROUP BY level, pos // 3
), runs AS (
    SELECT p.id, m.level, m.pos, m.digest, p.pos // (3 ** m.level)::BIGINT AS own
    FROM placed p JOIN nodes m ON m.rank = p.rank AND m.n > 1 AND m.pos // 3 = p.pos // (3 ** (m.level + 1))::BIGINT
    UNION ALL
    SELECT p.id, m.level, m.pos, m.digest, p.rank // (3 ** (m.level - 1000))::BIGINT
    FROM placed p JOIN upper_nodes m ON m.n > 1 AND m.pos // 3 = p.rank // (3 ** (m.level - 999))::BIGINT
), steps AS (
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY level) AS step,
           coalesce(string_agg(digest, '' ORDER BY pos) FILTER (pos < own), '') AS lefts,
           coalesce(string_agg(digest, '' ORDER BY pos) FILTER (pos > own), '') AS rights
    FROM runs GROUP BY id, level
), folds AS (
    SELECT id, 1 AS step, read_leaf AS digest FROM leaves
    UNION ALL
    SELECT f.id, f.step + 1, sha256(s.lefts || f.digest || s.rights) FROM folds f JOIN steps s ON s.id = f.id AND s.step = f.step
), folded AS (
    SELECT id, arg_max(digest, step) AS folded_root FROM folds GROUP BY id
), proofs AS (
    SELECT id, sha256(string_agg(lefts || rights, '' ORDER BY step)) AS proof FROM steps GROUP BY id
), top AS (
    SELECT digest AS root FROM upper_nodes WHERE n = 1
)
SELECT doc_id, leaf, s.digest AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN subroots s ON s.rank = p.rank JOIN folded f ON f.id = p.id LEFT JOIN proofs x ON x.id = p.id, top
"""
