"""SentencePiece encoding and decoding with merge-type vocabularies.

A text's symbols start as its characters. An agenda holds every adjacent pair that the
vocabulary knows as one piece, best score first and leftmost of equals; the best pair becomes
a symbol and its new neighbours enter. Pairs that the vocabulary doesn't know never merge, so
a text falls apart at them into fragments that can be encoded one by one, and a fragment seen
before costs a lookup. The library checks every new fragment of an Arrow batch.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Characters after which a batch is cut, and bytes, about, of a worker's cache before it
#: starts anew, with what an entry takes besides its text and ids; results don't depend on it.
BATCH_CHARS = 1 << 20
#: Characters up to which a fragment's agenda is a list.
SHORT = 24
INFINITE = float("inf")
CACHE_BYTES = 160 << 20
ENTRY_BYTES = 230
#: Fixed values of the model file: kinds of pieces, and the number of the merge-type model.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGE_TYPE = 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbered fields of a serialised message: whole numbers, or bytes for all else."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte, at = data[at], at + 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        kind = tag & 7
        if kind == 0:
            value, at = number(at)
        else:
            size, at = number(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Vocabulary:
    """Pieces, scores and kinds of a model file. Only models that merge pairs, leave characters
    as they are, put one space in front and keep spaces are taken; others raise ValueError."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        #: Minus the score: the lowest cost merges first, the leftmost of equals.
        self.costs: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.unknown = 0
        trainer, normalizer, n = {}, {}, 0
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                text, kind = piece[1].decode(), piece.get(3, NORMAL)
                if kind == NORMAL:
                    self.ids[text] = n
                    self.costs[text] = -struct.unpack("<f", piece.get(2, bytes(4)))[0]
                elif kind == UNKNOWN:
                    self.unknown = n
                elif kind == BYTE:
                    self.bytes[int(text[3:5], 16)] = n
                elif kind in (USER_DEFINED, UNUSED):
                    raise ValueError("pieces that users define, and unused ones, aren't taken")
                n += 1
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        plain = not normalizer.get(2) and normalizer.get(3, 1) == 1 and normalizer.get(4, 1) == 0 and normalizer.get(5, 1) == 1
        if trainer.get(3, 1) != MERGE_TYPE or trainer.get(24) or not plain:
            raise ValueError("not a merge-type model that keeps its text as it is")
        #: Neighbours that some piece holds: only between those can anything merge.
        self.joins = {a + b for piece in self.ids for a, b in pairwise(piece)}

    def pattern(self) -> re.Pattern | None:
        """Cuts a text into fragments between which nothing merges: spaces and a run of
        characters that pieces connect with each other, or with one that they connect with
        none. None if spaces don't only begin pieces."""
        if any(pair[1] == SPACE != pair[0] for pair in self.joins):
            return None
        home: dict[str, set[str]] = {}
        for a, b in self.joins:
            if a != SPACE:
                one, other = home.setdefault(a, {a}), home.setdefault(b, {b})
                if one is not other:
                    one |= other
                    home.update(dict.fromkeys(other, one))
        runs = {id(run): "".join(map(re.escape, sorted(run))) for run in home.values()}
        choices = [f"[{run}]+" for run in sorted(runs.values(), key=len, reverse=True)]
        return re.compile(f"{SPACE}*(?:{'|'.join([*choices, f'[^{SPACE}]'])})|{SPACE}+", re.DOTALL)

    def merge(self, fragment: str) -> list[str]:
        """Symbols of a fragment once no pair on the agenda is left. A short agenda is a list in
        the order of the text, a long one a heap."""
        return self._merge_list(fragment) if len(fragment) <= SHORT else self._merge_heap(fragment)

    def _merge_list(self, fragment: str) -> list[str]:
        symbols, costs, none = list(fragment), self.costs.get, INFINITE
        agenda = [costs(pair, none) for pair in map(add, symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best is none:
                break
            left = agenda.index(best)
            symbols[left] = text = symbols[left] + symbols.pop(left + 1)
            del agenda[left]
            if left:
                agenda[left - 1] = costs(symbols[left - 1] + text, none)
            if left < len(agenda):
                agenda[left] = costs(text + symbols[left + 1], none)
        return symbols

    def _merge_heap(self, fragment: str) -> list[str]:
        # a pair that one of its symbols has left meanwhile is stale: its text isn't that of its places
        symbols: list[str | None] = list(fragment)
        n, costs = len(symbols), self.costs
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(costs[pair], i, pair) for i, pair in enumerate(map(add, fragment, fragment[1:])) if pair in costs]
        heapify(agenda)
        while agenda:
            _, left, text = heappop(agenda)
            right = after[left]
            if symbols[left] is None or right >= n or symbols[left] + symbols[right] != text:
                continue
            symbols[left], symbols[right] = text, None
            after[left] = nxt = after[right]
            if nxt < n:
                before[nxt] = left
                if (pair := text + symbols[nxt]) in costs:
                    heappush(agenda, (costs[pair], left, pair))
            if (prev := before[left]) >= 0 and (pair := symbols[prev] + text) in costs:
                heappush(agenda, (costs[pair], prev, pair))
        return [s for s in symbols if s is not None]

    def encode(self, fragment: str) -> list[int]:
        """Ids of a fragment; a symbol that is no piece is given by its bytes if the vocabulary
        has them."""
        symbols = self.merge(fragment)
        try:
            return [self.ids[s] for s in symbols]
        except KeyError:
            out: list[int] = []
        for symbol in symbols:
            if symbol in self.ids:
                out.append(self.ids[symbol])
            elif self.bytes:
                out += [self.bytes[b] for b in symbol.encode()]
            else:
                out.append(self.unknown)
        if not self.bytes:  # unknown symbols in a row are one
            out = [x for i, x in enumerate(out) if x != self.unknown or not i or out[i - 1] != x]
        return out


class Coder(dict):
    """Fragment -> its ids as little-endian 32-bit bytes. A full cache becomes the old one, from
    which fragments in use come back. ``fresh`` holds fragments encoded since the last check."""

    #: A character that no piece joins with others stands in front of what the library checks.
    GUARD = "\n"

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.vocabulary = Vocabulary(path)
        alone = not any(self.GUARD in pair for pair in self.vocabulary.joins)
        #: Without bytes unknown characters in a row are one, so that cuts between them show.
        self.pattern = self.vocabulary.pattern() if alone and self.vocabulary.bytes else None
        self.guard = self.library.encode(self.GUARD)
        if self.guard[-1:] != self.vocabulary.encode(self.GUARD):  # not an id of its own
            self.pattern = None
        self.old: dict[str, bytes] = {}
        self.fresh: list[str] = []
        self.size = 0

    def __missing__(self, fragment: str) -> bytes:
        out = self.old.get(fragment)
        if out is None:
            ids = self.vocabulary.encode(fragment)
            out = struct.pack(f"<{len(ids)}I", *ids)
            self.fresh.append(fragment)
        self.size += ENTRY_BYTES + 2 * len(fragment) + len(out)
        self[fragment] = out
        return out

    def _fragments(self, text: str) -> list[str]:
        if not text:
            return []
        spaced = SPACE + text.replace(" ", SPACE)
        return self.pattern.findall(spaced) if self.pattern else [spaced]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, bool]:
        """The ids of all texts in one array, where each text's ids end, and whether the library
        agrees with every fragment that is new. A fragment is looked up once, however often
        the texts repeat it."""
        lists = [self._fragments(text) for text in texts]
        distinct = dict.fromkeys(chain.from_iterable(lists))
        parts = {f: self[f] for f in distinct}
        agrees = not self.check()
        if not agrees:
            parts = {f: self[f] for f in distinct}
        data = [b"".join(map(parts.__getitem__, fragments)) for fragments in lists]
        return np.frombuffer(b"".join(data), "<i4"), np.cumsum([0, *map(len, data)]) // 4, agrees

    def _library_ids(self, fragments: list[str]) -> list[list[int]]:
        if self.pattern is None:  # whole texts, in front of which the library puts a space
            return self.library.encode([f[1:] for f in fragments], num_threads=1)
        return [ids[len(self.guard) :] for ids in self.library.encode([self.GUARD + f for f in fragments], num_threads=1)]

    def _agrees(self, fragments: list[str]) -> bool:
        """Whether the library gives all fragments, in one text with the guard before each, the
        ids that they have here, with the guard's between them."""
        if not fragments or self.pattern is None:
            return not fragments
        first, guard = (np.array(x, "<i4").tobytes() for x in (self.guard[:-1], self.guard[-1:]))
        ours = first + b"".join([part for f in fragments for part in (guard, self[f])])
        return np.array(self.library.encode(self.GUARD + self.GUARD.join(fragments)), "<i4").tobytes() == ours

    def check(self) -> int:
        """Compare the fragments that are new since the last check with the library's ids, and
        retire a full cache; returns how many differed. The library's ids replace those."""
        different = 0
        if not self._agrees(self.fresh):
            for fragment, want in zip(self.fresh, self._library_ids(self.fresh), strict=True):
                ids = struct.pack(f"<{len(want)}I", *want)
                if ids != self[fragment]:
                    different += 1
                    self[fragment] = ids
        self.fresh = []
        if self.size > CACHE_BYTES // 2:
            self.old = dict(self)
            self.clear()
            self.size = 0
        return different


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """One per worker process; reused workers keep what they have seen."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def _slices(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column, some ``BATCH_CHARS`` at a time; null is the empty text."""
    out, chars = [], 0
    for value in column:
        text = value.as_py() or ""
        out.append(text)
        chars += len(text)
        if chars >= BATCH_CHARS:
            yield out
            out, chars = [], 0
    if out:
        yield out


def encode_documents(docs: DataFrame, model_path: str, decode: bool = False) -> DataFrame:
    """``doc_id, ids, agrees`` per row of ``docs``: a whole text's ids without begin or end, and,
    if asked for, ``decoded``, the library's text of those ids.

    ``agrees``: none of the fragments that were new in the row's batch got other ids from the
    library; where one did, the library's ids stand. Null and empty texts have no ids; repeated
    rows, null and repeated doc_ids are rows like any other; an empty table gives an empty
    result. Columns but doc_id and text are ignored, whatever their names. Long texts are
    encoded like short ones, in memory that grows with the text. No shuffle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = coder(model_path)
        for b in batches:
            at = 0
            for texts in _slices(b.column(1)):
                ids, ends, agrees = words.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                columns = {"doc_id": b.column(0).slice(at, len(texts)), "ids": lists, "agrees": pa.array([agrees] * len(texts))}
                if decode:
                    columns["decoded"] = pa.array(_decoded(words.library, ids, ends), pa.string())
                yield pa.RecordBatch.from_pydict(columns)
                at += len(texts)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, agrees boolean{', decoded string' if decode else ''}")


def _decoded(library, ids: np.ndarray, ends: np.ndarray) -> list[str]:
    """The library's texts of id lists that lie side by side."""
    flat = ids.tolist()
    return library.decode([flat[lo:hi] for lo, hi in pairwise(ends.tolist())], num_threads=1)


def decode_documents(rows: DataFrame, model_path: str, column: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the library's text of an id list; null and empty lists give
    the empty text. Other columns stay; one named ``decoded`` is replaced."""
    schema = rows.drop("decoded").schema
    at = schema.names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = coder(model_path).library
        for b in batches:
            lists = b.column(at)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            ids = lists.flatten().to_numpy(zero_copy_only=False)  # without null lists
            cuts = np.unique([0, *(np.flatnonzero(np.diff(ends // BATCH_CHARS)) + 1), len(sizes)]).tolist()
            texts: list[str] = []
            for lo, hi in pairwise(cuts):
                texts += _decoded(library, ids[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*schema.names, "decoded"])

    out = rows.select(*[F.col(f"`{c}`") for c in schema.names])
    return out.mapInArrow(run, type(schema)([*schema.fields]).add("decoded", "string"))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = default_model()
    rows = encode_documents(table(spark, sf_dir, "documents"), model, decode=True)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "agrees",
    )
