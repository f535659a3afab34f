import hashlib
import random
from collections import Counter

from tapeloom.llm import warc as W
from tapeloom.llm.common import new_path


def want(rows):
    data = [(p, (h or "").encode()) for p, _, h in rows]
    out = Counter()
    for p, b in data:
        ids = [q for q, c in data if c == b and q is not None]
        first = min(ids) if ids and len(b) >= 100 else None
        revisit = first is not None and p != first
        out[p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None] += 1
    return out


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert Counter(tuple(r) for r in W.op7_warc(spark, sf).collect()) == want(rows)


def test_round_trip_and_odd_rows(spark):
    rng = random.Random(3)
    page = "<html>" + "".join(rng.choice("abcdef ") for _ in range(400)) + "</html>"
    rows = [(9, "http://a/ b\r\nX: y", page), (4, "http://b", page), (4, "http://b", page), (None, None, page), (5, "u", None), (6, "u", ""), (7, "u", "x" * 99), (8, "u", "x" * 99), (1, "u", "y" * 300_000 + "\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as `first`", "3 as n")
    index = W.write_archives(pages, new_path(spark, "t"))
    got = W.read_archives(index).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want(rows)
    bodies = {r.payload_digest: bytes(r.payload) for r in got if r.payload is not None}
    assert set(bodies.values()) == {(h or "").encode() for _, _, h in rows}
    empty = W.write_archives(pages.limit(0), new_path(spark, "t"))
    assert W.read_archives(empty).collect() == []


def test_archives_roll_and_records_stand_alone(spark):
    import struct

    import zstandard

    pages = spark.range(3000).selectExpr("id as page_id", "'http://x/' || id as url", "'<p>' || sha2(cast(id as string), 256) || repeat(' common words of a page', 40) as html").coalesce(1)
    index = W.write_archives(pages, new_path(spark, "t"), archive_bytes=70_000)
    rows = index.collect()
    assert len({r.archive for r in rows}) > 1 and len(rows) == 3000
    r = next(x for x in rows if x.page_id == 2345)
    system, path = W.filesystem(r.archive)
    with system.open_input_file(path) as f:
        magic, size = struct.unpack("<II", f.read(8))
        assert magic == W.DICTIONARY_FRAME
        d = zstandard.ZstdCompressionDict(f.read(size))
        f.seek(r.offset)
        record = zstandard.ZstdDecompressor(dict_data=d).decompress(f.read(r.length))
    assert record.startswith(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:2345>")
    assert d.dict_id() != 0 and sum(x.length for x in rows) < 3000 * 600
    assert W.read_archives(index, payloads=False).count() == 3000
