"""Length-prefixed exchange messages as a Spark data source, ``spark.read.format("itch")``.

Where a message starts follows from the lengths of all before it, so an index pass hops the
length prefixes of each file and notes splits at exact frame borders, with the ordinal of each
one's first message. ``index_frames`` does that as a Spark job, a task per file, and writes an
index that any number of reads share; without one the source hops when it plans its splits.
``seq`` is a message's ordinal in its file, counted over all frames.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

HEADER = 11
SPLIT_BYTES = 32 << 20
#: Bytes read at a time.
CHUNK = 8 << 20
#: Fixed values of the feed: body bytes by message type.
LENGTHS = {
    "S": 12, "R": 39, "H": 25, "Y": 20, "L": 26, "V": 35, "W": 12, "K": 28, "J": 35, "h": 21, "A": 36, "F": 40,
    "E": 31, "C": 36, "X": 23, "D": 19, "U": 35, "P": 44, "Q": 40, "B": 19, "I": 50, "N": 20, "O": 48,
}
SCHEMA = "file string, seq long, msg_type string, locate int, ts_ns long, symbol string, ref long, new_ref long, side string, shares long, price long, state string"
#: Columns by the types that have them: (column, types, offset, bytes).
FIELDS = (
    ("symbol", "R", 11, 8), ("symbol", "AFP", 24, 8), ("ref", "AFECXDUP", 11, 8), ("new_ref", "U", 19, 8), ("side", "AFP", 19, 1),
    ("shares", "AFP", 20, 4), ("shares", "ECX", 19, 4), ("shares", "U", 27, 4), ("price", "AFP", 32, 4), ("price", "U", 31, 4), ("state", "H", 19, 1),
)


def encode(rows: Sequence[dict]) -> bytes:
    """Messages as a file holds them; fields that a type lacks are zero."""
    out = []
    for r in rows:
        kind = r["msg_type"]
        body = bytearray(LENGTHS[kind])
        body[0:1] = kind.encode()
        struct.pack_into(">HH", body, 1, r.get("locate") or 0, 0)
        body[5:11] = int(r.get("ts_ns") or 0).to_bytes(6, "big")
        for name, kinds, at, size in FIELDS:
            value = r.get(name)
            if kind in kinds and value is not None:
                text = name in ("symbol", "side", "state")
                body[at : at + size] = value.encode().ljust(size) if text else (int(value) % 2 ** (8 * size)).to_bytes(size, "big")
        out.append(struct.pack(">H", len(body)) + bytes(body))
    return b"".join(out)


def hop(chunks: Iterator[bytes], split_bytes: int = SPLIT_BYTES) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(start, end, first ordinal, frames, short frames, leftover bytes) of each split of a
    file, cut at frame borders every ``split_bytes`` or a little more. Short frames have less
    than a header; leftover bytes, of the last split, belong to no whole frame."""
    held, at, base = b"", 0, 0  # at: where the next frame starts, from the start of held
    start = ordinal = frames = short = 0
    for chunk in chunks:
        held, base, at = held[at:] + chunk, base + at, 0
        n = len(held)
        while at + 2 <= n:
            size = held[at] << 8 | held[at + 1]
            if at + 2 + size > n:
                break
            at += 2 + size
            frames += 1
            if size < HEADER:
                short += 1
            if base + at - start >= split_bytes:
                yield start, base + at, ordinal, frames, short, 0
                start, ordinal, frames, short = base + at, ordinal + frames, 0, 0
    if frames or len(held) > at:
        yield start, base + at, ordinal, frames, short, len(held) - at


def frames(data: bytes) -> list[int]:
    """Starts of the frames of ``data``, which begins and ends at a frame's border."""
    out, at = [], 0
    while at < len(data):
        out.append(at)
        at += 2 + (data[at] << 8 | data[at + 1])
    return out


def decode(data: bytes, starts: Sequence[int], file: str = "", first: int = 0) -> pa.RecordBatch:
    """Typed columns of the frames at ``starts``, whose ordinals count from ``first``; those
    shorter than a header are left out."""
    raw = np.frombuffer(data, np.uint8)
    at = np.asarray(starts, np.int64)
    size = (raw[at].astype(np.int64) << 8) | raw[at + 1] if len(at) else at
    ordinal = first + np.flatnonzero(size >= HEADER)
    at, size = at[size >= HEADER] + 2, size[size >= HEADER]

    def number(rows: np.ndarray, offset: int, width: int) -> np.ndarray:
        value = np.zeros(len(rows), np.uint64)
        for k in range(width):
            value = (value << np.uint64(8)) | raw[rows + offset + k]
        return value.view(np.int64)  # references of 64 bits keep their bits

    kind = raw[at] if len(at) else np.zeros(0, np.uint8)
    columns: dict[str, np.ndarray] = {}
    for name in ("symbol", "ref", "new_ref", "side", "shares", "price", "state"):
        columns[name] = np.full(len(at), None, object)
    for name, kinds, offset, width in FIELDS:
        rows = np.flatnonzero(np.isin(kind, [ord(k) for k in kinds]) & (size >= offset + width))
        if name in ("symbol", "side", "state"):
            fixed = np.ascontiguousarray(raw[at[rows, None] + offset + np.arange(width)]).view(f"S{width}")[:, 0]
            columns[name][rows] = np.char.rstrip(np.char.decode(fixed, "latin-1"), " ") if len(rows) else []
        else:
            columns[name][rows] = number(at[rows], offset, width)
    longs = {n: pa.array(columns[n], pa.int64()) for n in ("ref", "new_ref", "shares", "price")}
    texts = {n: pa.array(columns[n], pa.string()) for n in ("symbol", "side", "state")}
    return pa.RecordBatch.from_arrays(
        [pa.array([file] * len(at), pa.string()), pa.array(ordinal), pa.array([chr(k) for k in kind], pa.string()), pa.array(number(at, 1, 2).astype(np.int32)), pa.array(number(at, 5, 6)), texts["symbol"], longs["ref"], longs["new_ref"], texts["side"], longs["shares"], longs["price"], texts["state"]],
        ["file", "seq", "msg_type", "locate", "ts_ns", "symbol", "ref", "new_ref", "side", "shares", "price", "state"],
    )


#: Files up to so many bytes may be read without an index, whose splits the planner finds.
UNINDEXED_BYTES = 1 << 30


# ---- the index ---------------------------------------------------------------------------
INDEX = "path string, start long, end long, first_seq long, frames long, short_frames long, leftover_bytes long"


def _files(path: str) -> list[str]:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    info = system.get_file_info(inner)
    found = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
    return sorted(f.path for f in found)


def _bytes(path: str, files: list[str]) -> int:
    from pyarrow import fs

    system, _ = fs.FileSystem.from_uri(path)
    return sum(f.size for f in system.get_file_info(files)) if files else 0


def _below(path: str, file: str) -> str:
    """A file's path below ``path``; its base name if it is that path itself."""
    from pyarrow import fs

    root = fs.FileSystem.from_uri(path)[1].rstrip("/")
    return file[len(root) + 1 :] if file.startswith(root + "/") else file.rsplit("/", 1)[-1]


def _splits(root: str, path: str, split_bytes: int) -> Iterator[tuple]:
    from pyarrow import fs

    system, _ = fs.FileSystem.from_uri(root)
    with system.open_input_stream(path, compression=None) as f:
        yield from ((path, *s) for s in hop(iter(lambda: f.read(CHUNK), b""), split_bytes))


def index_frames(spark: SparkSession, path: str, index: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write the frame index of the files at ``path`` to ``index`` (Parquet, columns of
    ``INDEX``) and return it. A task hops through one file in chunks; files go in parallel."""
    files = _files(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = list(_splits(path, name, split_bytes))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 7, (pa.string(), *[pa.int64()] * 6), strict=True)], [c.split()[0] for c in INDEX.split(", ")])

    listed = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, len(files)), "path")
    listed.mapInArrow(run, INDEX).write.mode("overwrite").parquet(index)
    return spark.read.schema(INDEX).parquet(index)


def frame_counters(index: DataFrame) -> DataFrame:
    """``path, frames, short_frames, leftover_bytes`` of each file."""
    return index.groupBy("path").agg(*[F.sum(c).alias(c) for c in ("frames", "short_frames", "leftover_bytes")])


# ---- the source --------------------------------------------------------------------------
class Split(InputPartition):
    def __init__(self, path: str, start: int, end: int, first: int):
        self.path, self.start, self.end, self.first = path, start, end, first


class ItchReader(DataSourceReader):
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("format itch needs a path")
        self.path, self.index = options["path"], options.get("index")
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.locates = {int(options["locate"])} if "locate" in options else None
        self.types = set(options["types"]) if options.get("types") else None

    def partitions(self) -> list[Split]:
        if self.index:
            from pyarrow import parquet

            rows = parquet.read_table(self.index).select(["path", "start", "end", "first_seq"]).to_pylist()
            wanted = set(_files(self.path))
            rows = [(r["path"], r["start"], r["end"], r["first_seq"]) for r in rows if r["path"] in wanted]
        else:
            files = _files(self.path)
            if (size := _bytes(self.path, files)) > UNINDEXED_BYTES:
                raise ValueError(f"{size} bytes would be read to plan this: write an index with index_frames and name it")
            rows = [s[:4] for f in files for s in _splits(self.path, f, self.split_bytes)]
        return [Split(*r) for r in sorted(rows)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        from pyarrow import compute as pc
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(split.path) as f:
            f.seek(split.start)
            data = f.read(split.end - split.start)
        starts, name = frames(data), _below(self.path, split.path)
        for at in range(0, len(starts), 100_000):
            b = decode(data, starts[at : at + 100_000], name, split.first + at)
            if self.locates is not None:
                b = b.filter(pc.is_in(b.column("locate"), pa.array(sorted(self.locates), pa.int32())))
            if self.types is not None:
                b = b.filter(pc.is_in(b.column("msg_type"), pa.array(sorted(self.types), pa.string())))
            yield b


class ItchStreamReader(DataSourceStreamReader):
    """The files of a folder as a stream: new ones, and what is appended to known ones.

    An offset holds how far each file has been taken, ``{file: [bytes, frames]}``, always up to a
    frame's border; a frame that isn't whole yet waits. Each message comes once, with the
    ordinal that the batch source gives it. The driver hops through what is new, and after a
    restart once through all, to find borders; messages are read by tasks.
    """

    def __init__(self, options: dict):
        self.source = ItchReader(options)
        self.taken: dict[str, list[int]] = {}

    def _new(self, file: str, start: list[int], end: int | None = None) -> list[tuple]:
        """Splits of a file from ``start`` on, or up to byte ``end``: (start, end, first, frames)."""
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.source.path)
        at, ordinal = start

        def chunks(f) -> Iterator[bytes]:
            f.seek(at)
            left = f.size() - at if end is None else end - at
            while left > 0 and (chunk := f.read(min(CHUNK, left))):
                left -= len(chunk)
                yield chunk

        with system.open_input_file(file) as f:
            return [(at + lo, at + hi, ordinal + first, n) for lo, hi, first, n, _, _ in hop(chunks(f), self.source.split_bytes) if n]

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        out = dict(self.taken)
        for file in _files(self.source.path):
            if splits := self._new(file, self.taken.get(file, [0, 0])):
                _, end, first, n = splits[-1]
                out[file] = [end, first + n]
        return out

    def partitions(self, start: dict, end: dict) -> list[Split]:
        out = []
        for file, (upto, _) in sorted(end.items()):
            begin = start.get(file, [0, 0])
            if upto > begin[0]:
                out += [Split(file, lo, hi, first) for lo, hi, first, _ in self._new(file, begin, upto)]
        return out

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        return self.source.read(split)

    def commit(self, end: dict) -> None:
        self.taken = dict(end)


class PushingReader(ItchReader):
    """Takes equality and membership filters on locate and msg_type off the query. Spark asks
    for them only if ``spark.sql.python.filterPushdown.enabled`` is set, and refuses a reader
    that offers to take them if it isn't."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("locate",):
                self.locates = values if self.locates is None else self.locates & values
            elif values is not None and f.attribute == ("msg_type",):
                self.types = values if self.types is None else self.types & values
            else:
                yield f


class ItchSource(DataSource):
    """Options: path; index, of ``index_frames``, or splitBytes; the filters locate and types,
    applied before rows reach Spark; pushFilters, true where the session pushes filters to
    Python sources."""

    @classmethod
    def name(cls) -> str:
        return "itch"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ItchStreamReader:  # noqa: N802
        return ItchStreamReader({k.lower(): v for k, v in self.options.items()})

    def reader(self, schema) -> ItchReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return (PushingReader if options.get("pushfilters", "false").lower() == "true" else ItchReader)(options)
