"""Binary feature dumps and flat logit files as data sources and sinks, and the weight files."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tapeloom.operators.model import CLASSES, HIDDEN, INPUTS, Int8Weights, Weights

#: Fixed values of the formats.
DUMP_MAGIC, DUMP_VERSION = 0x53544D32, 2
FLOAT_MAGIC, FLOAT_VERSION = 0x53544D57, 1
INT8_MAGIC, INT8_VERSION = 0x53544D51, 1
RECORD = np.dtype([("ts", "<u8"), ("mid", "<i4"), ("spread", "<i4"), ("f", "<f4", (INPUTS,))])
SCHEMA = "ts_ns long, mid long, spread long, f array<float>"
SPLIT_ROWS = 400_000


def header(data: bytes, magic: int, version: int, what: str) -> None:
    if len(data) < 8:
        raise ValueError(f"{what}: the header is cut off")
    found = struct.unpack("<II", data[:8])
    if found[0] != magic:
        raise ValueError(f"{what}: magic is {found[0]:#x}, not {magic:#x}")
    if found[1] != version:
        raise ValueError(f"{what}: version is {found[1]}, not {version}")


class Split(InputPartition):
    def __init__(self, path: str, first: int, rows: int):
        self.path, self.first, self.rows = path, first, rows


def data_files(uri: str):
    """The file system of ``uri``, and its files (or it alone) by path."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    info = system.get_file_info(path)
    files = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
    return system, sorted(files, key=lambda f: f.path)


class DumpReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Split]:
        system, files = data_files(self.path)
        out = []
        for f in files:
            with system.open_input_file(f.path) as data:
                header(data.read(8), DUMP_MAGIC, DUMP_VERSION, f.path)
            rows, rest = divmod(f.size - 8, RECORD.itemsize)
            if rest:
                raise ValueError(f"{f.path}: {rest} bytes follow the last record")
            out += [Split(f.path, at, min(SPLIT_ROWS, rows - at)) for at in range(0, rows, SPLIT_ROWS)]
        return out

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(split.path) as f:
            f.seek(8 + split.first * RECORD.itemsize)
            rows = np.frombuffer(f.read(split.rows * RECORD.itemsize), RECORD)
        for at in range(0, len(rows), 50_000):
            r = rows[at : at + 50_000]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * INPUTS), pa.array(np.ascontiguousarray(r["f"]).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(r["ts"].astype(np.int64)), pa.array(r["mid"].astype(np.int64)), pa.array(r["spread"].astype(np.int64)), lists], ["ts_ns", "mid", "spread", "f"])


class Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class DumpWriter(DataSourceArrowWriter):
    """A file of its own for each task, under a name that starts with a dot until the job
    commits."""

    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path)
        system.create_dir(path, recursive=True)
        name = f"{path}/.{uuid.uuid4().hex}.bin"
        with system.open_output_stream(name, compression=None) as out:
            out.write(struct.pack("<II", DUMP_MAGIC, DUMP_VERSION))
            for b in batches:
                rows = np.zeros(b.num_rows, RECORD)
                rows["ts"], rows["mid"], rows["spread"] = (b.column(c).to_numpy() for c in ("ts_ns", "mid", "spread"))
                flat = b.column("f").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, INPUTS)
                rows["f"] = flat  # null features are NaN
                out.write(rows.tobytes())
        return Written(name)

    def commit(self, messages) -> None:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                folder, _, name = m.path.rpartition("/")
                system.move(m.path, f"{folder}/{name.lstrip('.')}")

    def abort(self, messages) -> None:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.path)


class LogitReader(DataSourceReader):
    """Rows are numbered through all files, in the order of their names."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Split]:
        out, first = [], 0
        for f in data_files(self.path)[1]:
            rows, rest = divmod(f.size, 4 * CLASSES)
            if rest:
                raise ValueError(f"{f.path}: {f.size} bytes aren't whole rows of {CLASSES} numbers")
            for at in range(0, rows, SPLIT_ROWS):
                split = Split(f.path, at, min(SPLIT_ROWS, rows - at))
                split.number = first + at
                out.append(split)
            first += rows
        return out

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(split.path) as f:
            f.seek(split.first * 4 * CLASSES)
            values = np.frombuffer(f.read(split.rows * 4 * CLASSES), "<f4").reshape(-1, CLASSES)
        for at in range(0, len(values), 50_000):
            v = values[at : at + 50_000]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * CLASSES), pa.array(np.ascontiguousarray(v).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(split.number + at + np.arange(len(v))), lists], ["row", "logits"])


class LogitWriter(DumpWriter):
    """Flat float32, without a header: a file for each task, named by its place among them, so
    that all files one after the other are the rows in the order of the frame."""

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyarrow import fs
        from pyspark import TaskContext

        system, path = fs.FileSystem.from_uri(self.path)
        system.create_dir(path, recursive=True)
        name = f"{path}/.{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.f32"
        with system.open_output_stream(name, compression=None) as out:
            for b in batches:
                lists = b.column("logits")
                if lists.null_count or any(n != CLASSES for n in pa.compute.list_value_length(lists).unique().to_pylist()):
                    raise ValueError(f"each row must have {CLASSES} logits")
                values = lists.flatten().to_numpy(zero_copy_only=False)  # a null logit is NaN
                out.write(np.ascontiguousarray(values, "<f4").tobytes())
        return Written(name)


class FlatLogits(DataSource):
    """``flatlogits``: rows of the three logits as flat float32, in the order of the frame. To
    write them in the order of a key, sort the frame by it; to append would break the order and
    is refused. Reading numbers the rows from 0."""

    @classmethod
    def name(cls) -> str:
        return "flatlogits"

    def schema(self) -> str:
        return "row long, logits array<float>"

    def reader(self, schema) -> LogitReader:
        return LogitReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> LogitWriter:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.options["path"])
        if system.get_file_info(path).type != fs.FileType.NotFound and data_files(self.options["path"])[1]:
            raise ValueError(f"{path} has files already")
        return LogitWriter(self.options["path"])


class FeatureDump(DataSource):
    @classmethod
    def name(cls) -> str:
        return "featuredump"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DumpReader:
        return DumpReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DumpWriter:
        return DumpWriter(self.options["path"])


def _take(data: bytes, at: int, kind: str, shape: tuple[int, ...], name: str) -> tuple[np.ndarray, int]:
    size = int(np.prod(shape)) * np.dtype(kind).itemsize
    if at + size > len(data):
        raise ValueError(f"{name} is cut off")
    return np.frombuffer(data[at : at + size], kind).reshape(shape).copy(), at + size


_ARRAYS = (("w0", (HIDDEN, INPUTS)), ("b0", (HIDDEN,)), ("w2", (HIDDEN, HIDDEN)), ("b2", (HIDDEN,)), ("w4", (CLASSES, HIDDEN)), ("b4", (CLASSES,)))


def _parse(data: bytes, magic: int, version: int, quantized: bool) -> dict[str, np.ndarray]:
    header(data, magic, version, "weights")
    if len(data) < 20 or struct.unpack("<3I", data[8:20]) != (INPUTS, HIDDEN, CLASSES):
        raise ValueError(f"weights: the layers aren't {INPUTS}, {HIDDEN}, {CLASSES}")
    plan = [("mean", "<f4", (INPUTS,)), ("std", "<f4", (INPUTS,))]
    plan += [("scales", "<f4", (3,)), ("weight_scales", "<f4", (3,))] if quantized else []
    plan += [(n, "i1" if quantized and n[0] == "w" else "<f4", s) for n, s in _ARRAYS]
    out, at = {}, 20
    for name, kind, shape in plan:
        out[name], at = _take(data, at, kind, shape, name)
    if at != len(data):
        raise ValueError(f"weights: {len(data) - at} bytes follow the last array")
    return out


def load_weights(data: bytes) -> Weights:
    return Weights(**_parse(data, FLOAT_MAGIC, FLOAT_VERSION, False))


def load_int8(data: bytes) -> Int8Weights:
    return Int8Weights(**_parse(data, INT8_MAGIC, INT8_VERSION, True))


def dump_weights(w: Weights) -> bytes:
    parts = [w.mean, w.std] + [getattr(w, n) for n, _ in _ARRAYS]
    return struct.pack("<5I", FLOAT_MAGIC, FLOAT_VERSION, INPUTS, HIDDEN, CLASSES) + b"".join(p.astype("<f4").tobytes() for p in parts)


def dump_int8(w: Int8Weights) -> bytes:
    parts = [a.astype("<f4").tobytes() for a in (w.mean, w.std, w.scales, w.weight_scales)]
    parts += [getattr(w, n).astype("i1" if n[0] == "w" else "<f4").tobytes() for n, _ in _ARRAYS]
    return struct.pack("<5I", INT8_MAGIC, INT8_VERSION, INPUTS, HIDDEN, CLASSES) + b"".join(parts)
