"""Packing tokenised documents into fixed-length sequences: dominance reduction, then best fit.

Pieces of one length are interchangeable, so an instance is its histogram of lengths, which
has as many rows as a sequence has tokens, however many documents there are. The packing of
that histogram is exact for the whole corpus: patterns of lengths with multiplicities. Pieces
then find their place by their rank within their length.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import kept, staged, table

CAPACITY = 4096
#: Id that ends each document.
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
CHUNKS = 64
#: Bytes, about, that a worker's word cache may take before it starts anew, and what an entry
#: takes besides its word and ids; results don't depend on it.
CACHE_BYTES = 96 << 20
ENTRY_BYTES = 180


# ---- tokens ------------------------------------------------------------------------------
class WordCoder(dict):
    """UTF-8 word -> its ids as little-endian 32-bit bytes, from the ``tokenizers`` model.

    A tokenizer of the known kind drops white space and never joins across it, so a text's ids
    are those of its words, and a word seen before costs a lookup. Words of printable ASCII and
    Latin-1 are split by the tokenizer's own pattern and given to its model; all others go
    through its whole pipeline. The file says whether it is of that kind; the texts of any
    other tokenizer go through its pipeline whole.
    """

    #: The known normalizer and pre-tokenizer, its pattern with Latin-1's letters
    #: and numbers spelled out, and the characters that the spelling holds for.
    _NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    _PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    _PRE_TOKENIZER = {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    }
    _LETTERS = "a-zªµºß-öø-ÿ"
    _NUMBERS = "0-9²³¹¼-¾"
    _SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
    _PLAIN = re.compile(r"[!-~¡-¬®-ÿ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.by_word = (
            (parts["normalizer"], parts["pre_tokenizer"], parts["post_processor"]) == (self._NORMALIZER, self._PRE_TOKENIZER, None)
            and parts["model"]["type"] == "BPE"
            and all(t["content"].startswith("<|") for t in parts["added_tokens"])
        )
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}
        self.size = 0
        # byte-level alphabet: printable bytes stand for themselves, others follow from 256
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.alphabet = [chr(b) if b in shown else chr(next(rest)) for b in range(256)]

    def _room_for(self, entry: int) -> None:
        self.size += ENTRY_BYTES + entry
        if self.size > CACHE_BYTES:
            self.clear()
            self.parts.clear()
            self.size = ENTRY_BYTES + entry

    def _encode(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if self._PLAIN.fullmatch(text) and "<|" not in text:
            out = b"".join([self.parts.get(p) or self.part(p) for p in self._SPLIT.findall(text.lower())])
        else:
            out = self._encode(text)
        self._room_for(len(word) + len(out))
        self[word] = out
        return out

    def part(self, part: str) -> bytes:
        ids = [t.id for t in self.model.tokenize("".join([self.alphabet[b] for b in part.encode()]))]
        out = struct.pack(f"<{len(ids)}I", *ids)
        self._room_for(2 * len(part) + len(out))
        self.parts[part] = out
        return out

    def ids(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.__getitem__, text.split())) if self.by_word else self._encode(text.decode())


def coder(path: str) -> WordCoder:
    """One per worker process; reused workers keep what they have seen until other work begins."""
    return kept(path, lambda: WordCoder(path))


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if kept, ``ids``, per piece. Whole
    texts; no shuffle."""
    end = struct.pack("<I", end_id)
    width = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = coder(tokenizer_path)
        for b in batches:
            owner, start, length, crc, kept = [], [], [], [], []
            for row, text in enumerate(b.column(1)):
                data = words.ids(text.as_py()) + end
                for at in range(0, len(data), width):
                    part = data[at : at + width]
                    owner.append(row)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(part)
            start, length = np.array(start, np.int64), np.array(length, np.int64)
            columns = [b.column(0).take(pa.array(owner, pa.int64())), pa.array(start // capacity, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                flat = pa.array(np.frombuffer(b"".join(kept), "<i4"))
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), flat))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, schema)


# ---- packing a histogram -----------------------------------------------------------------
Pattern = tuple[tuple[int, int], ...]  # (length, times), in the order of their places


class Lengths:
    """A multiset of lengths, with the neighbours that the reduction asks for."""

    def __init__(self, counts: dict[int, int]):
        self.count = {k: v for k, v in counts.items() if v}
        self.order = sorted(self.count)

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            self.order.pop(bisect_left(self.order, length))

    def largest(self, most: int, besides: int = 0) -> int:
        """Largest length up to ``most`` once one piece of length ``besides`` is set aside."""
        at = bisect_right(self.order, most) - 1
        if at >= 0 and self.order[at] == besides and self.count[besides] == 1:
            at -= 1
        return self.order[at] if at >= 0 else 0

    def smallest(self, k: int, besides: int) -> list[int]:
        out: list[int] = []
        for x in self.order:
            out += [x] * min(k - len(out), self.count[x] - (x == besides))
            if len(out) == k:
                break
        return out

    def best_pair(self, most: int, besides: int) -> int:
        """Largest sum of two pieces up to ``most``, one piece of ``besides`` set aside."""
        best, hi = 0, len(self.order) - 1
        for lo, a in enumerate(self.order):
            while hi >= lo and a + self.order[hi] > most:
                hi -= 1
            if hi < lo:
                break
            for b in self.order[hi : lo - 1 if lo else None : -1][:2]:
                need = {a: 1, b: 1} if a != b else {a: 2}
                if all(self.count[x] - (x == besides) >= n for x, n in need.items()):
                    best = max(best, a + b)
                    break
        return best


def dominance_reduction(lengths: Lengths, capacity: int) -> list[tuple[Pattern, int]]:
    """Fix the sets that provably dominate every other set with the same largest piece, and
    take them out of ``lengths``. For a piece j with space r beside it and k the largest piece
    that fits there:

    - nothing fits: j stays alone;
    - k = r: no other filling of r can be better than one piece that fills it;
    - no two pieces fit, or no three do and no two sum to more than k: whatever else stands
      beside j could stand where k does.

    Sweeps from the largest length down, until one changes nothing.
    """
    fixed: list[tuple[Pattern, int]] = []
    changed = True
    while changed:
        changed = False
        for j in reversed(lengths.order[:]):
            while j in lengths.count:
                r = capacity - j
                k = lengths.largest(r, j)
                if not k:
                    n = lengths.count[j] if 2 * j > capacity or lengths.count[j] == 1 else 0
                    if not n:
                        break
                    lengths.take(j, n)
                    fixed.append((((j, 1),), n))
                    changed = True
                    continue
                if k != r:
                    low = lengths.smallest(3, j)
                    if not (len(low) < 2 or low[0] + low[1] > r or ((len(low) < 3 or sum(low) > r) and lengths.best_pair(r, j) <= k)):
                        break
                if k == j:
                    n = lengths.count[j] // 2
                    lengths.take(j, 2 * n)
                    fixed.append((((j, 2),), n))
                else:
                    # while one of each is left, the same reasoning holds for the next pair,
                    # as taking pieces away leaves fewer alternatives
                    n = min(lengths.count[j], lengths.count[k])
                    lengths.take(j, n)
                    lengths.take(k, n)
                    fixed.append((((j, 1), (k, 1)), n))
                changed = True
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit, largest first, of the remaining pieces. Open sequences are kept by their free
    space; one that takes a piece and still fits another is the next best fit for it, so whole
    runs of equal sequences fill at once."""
    spaces: list[int] = []  # sorted
    bins: dict[int, list[tuple[Pattern, int]]] = {}

    def put(space: int, pattern: Pattern, n: int) -> None:
        if n:
            if space not in bins:
                insort(spaces, space)
                bins[space] = []
            bins[space].append((pattern, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                space, pattern, n = capacity, (), left
            else:
                space = spaces[at]
                pattern, n = bins[space].pop()
                if not bins[space]:
                    del bins[space]
                    spaces.pop(at)
            times = space // length
            full = min(n, left // times)
            if full:
                put(space - times * length, (*pattern, (length, times)), full)
                left -= full * times
            rest = n - full
            if left and rest and left < times:
                put(space - left * length, (*pattern, (length, left)), 1)
                rest, left = rest - 1, 0
            if pattern:
                put(space, pattern, rest)
    return [x for space in spaces for x in bins[space]]


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns and how many sequences have each."""
    lengths = Lengths(counts)
    fixed = dominance_reduction(lengths, capacity)
    return fixed + best_fit(lengths.count, capacity)


def places(patterns: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """Runs by (length, first rank): the sequences they fill, how many of a run's pieces each
    sequence takes, and where in it they start."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for length, times in pattern:
            first = taken.get(length, 0)
            rows.append((length, first, sequence, times, offset))
            taken[length] = first + n * times
            offset += length * times
        sequence += n
    rows.sort()
    return dict(zip(("length", "first", "sequence", "times", "offset"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, chunks: int = CHUNKS) -> DataFrame:
    """``pieces(doc_id, piece, length, ...)`` -> adds ``sequence_id, offset``.

    The driver gets the histogram of lengths, ``capacity`` rows at most, and sends back the
    runs of its packing, whose number depends on the capacity only. Ranks within a length are
    counted by (length, chunk of the hashed id), so that a common length is dealt out.
    """
    spark = pieces.sparkSession
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    if any(k > capacity or k < 1 for k in counts):
        raise ValueError(f"piece lengths must be 1 to {capacity}")
    runs = spark.sparkContext.broadcast(places(pack_lengths(counts, capacity)))
    order = [c for c in ("doc_id", "piece", "ids_crc32", "start") if c in pieces.columns]  # ties are alike throughout
    chunk = F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int")
    rows = pieces.withColumn("_chunk", chunk)
    along = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("length", "_chunk").count()
    starts = starts.select("length", "_chunk", F.coalesce(F.sum("count").over(along), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("length", "_chunk").orderBy(*order))
    ranked = rows.withColumn("_n", inside).join(starts, ["length", "_chunk"])
    ranked = ranked.select(*pieces.columns, (F.col("_start") + F.col("_n") - 1).alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = runs.value
        keys = (at["length"] << 48) + at["first"]
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "_rank"))
            k = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            i = rank - at["first"][k]
            sequence = at["sequence"][k] + i // at["times"][k]
            offset = at["offset"][k] + i % at["times"][k] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], [*b.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Pieces of all ``docs`` with their place in sequences of at most ``capacity`` tokens:
    doc_id, piece, start, length, ids_crc32, ids (unless dropped), sequence_id, offset.

    A document is its ids and an end id; null counts as the empty text, so each has a piece.
    Only documents over the capacity are cut; their whole pieces fill sequences of their own.
    Repeated rows and doc_ids, null ids too, are packed as documents of their own. An empty
    table gives an empty result. Columns but doc_id and text are ignored.
    """
    return pack_pieces(staged(cut_documents(docs, tokenizer_path, capacity, keep_ids=keep_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the token sequences themselves, from pieces with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(table(spark, sf_dir, "documents"), default_tokenizer(), CAPACITY, keep_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
