"""WARC archives compressed with a dictionary of their own, record by record.

An archive starts with a skippable frame that holds the Zstandard dictionary; each record is a
frame of its own, so a reader can start at any record of the index.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import new_path, staged, table

#: Payloads of fewer bytes are never revisited.
REVISIT_FROM = 100
#: A new archive starts once this many bytes are written.
ARCHIVE_BYTES = 64 << 20
#: The dictionary, and the records at an archive's start that it is built from.
DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 2 << 20
LEVEL = 3
#: Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, record_type string, archive string, offset long, length long"


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    number = uri.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def build_record(page_id, url, payload: bytes, digest: str, first: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, with the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    clean = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_uri(page_id)}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {record_uri(first)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]):
    """A dictionary trained on the records; of too few to train on, their own bytes."""
    import zstandard as z

    if len(records) >= 16:
        try:
            return z.train_dictionary(DICTIONARY_BYTES, records, k=256, d=8)
        except z.ZstdError:
            pass
    return z.ZstdCompressionDict(b"".join(records)[-DICTIONARY_BYTES:], dict_type=z.DICT_TYPE_RAWCONTENT)


def filesystem(uri: str):
    """pyarrow's file system for a shared folder, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ArchiveWriter:
    """One task's archives. Names are unique to the attempt; a lost or repeated task leaves
    files that no index names."""

    def __init__(self, folder: str, archive_bytes: int):
        self.folder, self.archive_bytes = folder, archive_bytes
        self.waiting: list[tuple] = []
        self.waiting_bytes = 0
        self.out = None

    def add(self, page_id, kind: str, record: bytes) -> Iterator[tuple]:
        if self.out is not None:
            yield self._write(page_id, kind, record)
            return
        self.waiting.append((page_id, kind, record))
        self.waiting_bytes += len(record)
        if self.waiting_bytes >= SAMPLE_BYTES:
            yield from self._open()

    def _open(self) -> Iterator[tuple]:
        import zstandard as z

        made = build_dictionary([r for _, _, r in self.waiting])
        data = made.as_bytes()
        self.compressor = z.ZstdCompressor(level=LEVEL, dict_data=made)
        self.archive = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
        system, path = filesystem(self.archive)
        self.out = system.open_output_stream(path, compression=None)
        self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(data)) + data)
        self.at = 8 + len(data)
        waiting, self.waiting, self.waiting_bytes = self.waiting, [], 0
        for one in waiting:
            yield from self.add(*one)  # goes into the next archive if this one is full

    def _write(self, page_id, kind, record) -> tuple:
        frame = self.compressor.compress(record)
        self.out.write(frame)
        row = (page_id, kind, self.archive, self.at, len(frame))
        self.at += len(frame)
        if self.at >= self.archive_bytes:
            self._close()
        return row

    def _close(self) -> None:
        self.out.close()
        self.out = None

    def finish(self) -> Iterator[tuple]:
        while self.waiting:
            yield from self._open()
        if self.out is not None:
            self._close()


def plan_records(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """``page_id, url, payload, digest, first, revisit``. The responses of repeated payloads
    come from a pre-aggregated table that holds just those; a payload that a third of all
    pages share is one row there, and AQE splits its side of the join if it isn't small."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    seen = rows.where(F.length("payload") >= revisit_from).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = staged(seen.where("n > 1").select("digest", "first"), "repeated")
    joined = rows.join(repeated, "digest", "left")
    return joined.withColumn("revisit", F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")))


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` under ``folder``, a URI that all executors share,
    and return the index: page_id, record_type, archive, offset, length of each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(folder)
        system.create_dir(path, recursive=True)
        writer = ArchiveWriter(folder, archive_bytes)

        def rows(found: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            columns = zip(*found, strict=True) if found else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "record_type", "archive", "offset", "length"])

        for b in batches:
            found: list[tuple] = []
            for i in range(b.num_rows):
                page_id, url, payload, digest, first, revisit = (c[i].as_py() for c in b.columns)
                record = build_record(page_id, url, payload, digest, first, revisit, date)
                found += writer.add(page_id, "revisit" if revisit else "response", record)
            yield rows(found)
        yield rows(list(writer.finish()))

    planned = plan_records(pages).select("page_id", "url", "payload", "digest", "first", "revisit")
    return staged(planned.mapInArrow(run, INDEX), "warc-index")


def read_records(archive: str) -> Iterator[dict]:
    """All records of one archive, first to last, payload digests verified."""
    import zstandard as z

    system, path = filesystem(archive)
    with system.open_input_stream(path, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != DICTIONARY_FRAME:
            raise ValueError(f"{archive}: no dictionary frame")
        context = z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(f.read(size)))
        text = io.BufferedReader(context.stream_reader(f, read_across_frames=True), 1 << 18)
        while line := text.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError(f"{archive}: a record starts with {line[:40]!r}")
            head = {}
            while (line := text.readline()) != b"\r\n":
                name, _, value = line.decode().partition(": ")
                head[name] = value.rstrip("\r\n")
            block = text.read(int(head["Content-Length"]))
            if len(block) != int(head["Content-Length"]) or text.read(4) != b"\r\n\r\n":
                raise ValueError(f"{archive}: a record is cut off")
            http, _, payload = block.partition(b"\r\n\r\n")
            length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
            revisit = head["WARC-Type"] == "revisit"
            if not revisit and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                raise ValueError(f"{archive}: the payload of {head['WARC-Record-ID']} differs from its digest")
            yield {
                "page_id": page_of(head["WARC-Record-ID"]),
                "url": head["WARC-Target-URI"],
                "payload_bytes": length,
                "payload_digest": digest,
                "record_type": head["WARC-Type"],
                "refers_to": page_of(head["WARC-Refers-To"]) if revisit else None,
                "payload": None if revisit else payload,
            }


def read_archives(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Read every archive that an index names, one task to an archive, from its first record
    to its last: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if
    asked for, payload (null for revisits)."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column(0).to_pylist():
                rows, size = [], 0
                for r in read_records(archive):
                    if not payloads:
                        r["payload"] = None
                    rows.append(r)
                    size += len(r["payload"] or b"") + 200
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    archives = index.select("archive").distinct()
    n = archives.count()
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return archives.repartition(max(1, min(n, 10_000))).mapInArrow(run, ddl)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages, then read the archives back.

    Null html is an empty payload. Rows that repeat the smallest page_id of a payload are
    responses, as it is; null page_ids revisit it, or are responses if there are only nulls.
    An empty table writes nothing and gives an empty result. Columns but page_id, url and html
    are ignored.
    """
    index = write_archives(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_archives(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes
  FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first IS NOT NULL AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""
