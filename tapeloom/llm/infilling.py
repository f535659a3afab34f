"""Fill-in-the-middle: seeded cuts of documents at token borders, from an index of distinct texts.

Copies of a text share its borders, so these are found once per distinct text and kept as an
Elias-Fano list, a few bits a token. Documents join the index by the text's digest, draw the
ranks of their two cuts from their id, and select just those two borders from the list.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import staged, table, text_or_empty

#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many are rearranged, and of 100 of those so many with the suffix first.
REARRANGED, SUFFIX_FIRST = 90, 20
#: A text is hot from so many copies on, or this share of all rows if that is more: hot texts
#: are fewer than its inverse, whatever the number of rows.
HOT_ROWS, HOT_SHARE = 64, 1e-4


# ---- borders -----------------------------------------------------------------------------
def borders(text: str) -> np.ndarray:
    """Where tokens begin, in code points, and the end: a run of ASCII letters is a token, and
    so is any other character."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    letter = ((points | 32) - np.uint32(97)) < 26
    starts = np.ones(len(points), bool)
    starts[1:] = ~(letter[1:] & letter[:-1])
    return np.append(np.flatnonzero(starts), len(points))


def pack(values: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """Elias-Fano list of ascending whole numbers: their count, how many low bits each has, the
    low bits side by side, and the high bits as gaps in unary."""
    n, last = len(values), int(values[-1])
    width = max(0, (last // n).bit_length() - 1)
    ones = np.zeros((last >> width) + n, bool)
    ones[(values >> width) + np.arange(n)] = True
    low = (values[:, None] >> np.arange(width)) & 1
    return n, width, np.packbits(low.astype(bool).ravel(), bitorder="little").tobytes(), np.packbits(ones, bitorder="little").tobytes()


def select(width: int, low: bytes, high: bytes, ranks: np.ndarray) -> np.ndarray:
    """The values at ``ranks`` of an Elias-Fano list; only their own low bits are read."""
    data = np.frombuffer(high, np.uint8)
    upto = np.cumsum(np.bitwise_count(data), dtype=np.int64)
    place = np.searchsorted(upto, ranks, side="right")
    skip = ranks - np.where(place > 0, upto[place - 1], 0)  # ones of the byte before the one asked for
    bits = np.unpackbits(data[place, None], axis=1, bitorder="little")
    inside = np.argmax(np.cumsum(bits, axis=1) > skip[:, None], axis=1)
    at = ranks[:, None] * width + np.arange(width)
    rest = (np.frombuffer(low, np.uint8)[at >> 3] >> (at & 7)) & 1 if width else np.zeros((len(ranks), 0), np.int64)
    return ((place * 8 + inside - ranks) << width) + (rest.astype(np.int64) << np.arange(width)).sum(axis=1)


ENTRY = T.StructType().add("text", "string").add("n", "integer").add("width", "integer").add("low", "binary").add("high", "binary")
CUT = T.StructType().add("first", "long").add("second", "long")


@F.arrow_udf(ENTRY)
def entry(text: pa.Array) -> Any:
    """A distinct text with the list of its borders; as an aggregate it leaves texts where they
    have been dealt to."""
    value = text[0].as_py()
    return {"text": value, **dict(zip(("n", "width", "low", "high"), pack(borders(value)), strict=True))}


@F.arrow_udf(CUT)
def selected(width: pa.Array, low: pa.Array, high: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    """Two borders of each list; none where no rank is asked for."""
    rows = []
    for w, a, b, i, j in zip(width, low, high, first, second, strict=True):
        rows.append(select(w.as_py(), a.as_py(), b.as_py(), np.array([i.as_py(), j.as_py()])).tolist() if i.is_valid else (None, None))
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(2)], ["first", "second"])


# ---- index of distinct texts ---------------------------------------------------------------
def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """``key, text``, one row per distinct text, dealt by ``key``, its SHA-256. Copies are
    combined before the shuffle. That a group holds one text only is verified by a second hash
    and the length of every copy; another text under the same key is an error."""
    text = text_or_empty()
    rows = docs.select(_key(text).alias("key"), text.alias("text"), F.struct(F.xxhash64(text).alias("hash"), F.octet_length(text).alias("bytes")).alias("content"))
    groups = rows.groupBy("key").agg(F.first("text").alias("text"), F.min("content").alias("least"), F.max("content").alias("most"))
    verified = F.when(F.col("least") == F.col("most"), F.col("text")).otherwise(F.raise_error(F.lit("different texts have one SHA-256")))
    return groups.select("key", verified.alias("text"))


def _joined(docs: DataFrame) -> DataFrame:
    """``doc_id, text, n, width, low, high`` per row of ``docs``.

    Texts are shuffled once, as the index; documents come to them with nothing but their id and
    key. Texts with many copies, found by counting keys, are repeated over several parts, and
    their documents are dealt over those.
    """
    rows = staged(docs.select("doc_id", _key(text_or_empty()).alias("key")), "text-keys")
    limit = max(HOT_ROWS, int(rows.count() * HOT_SHARE))
    counts = rows.groupBy("key").count().where(F.col("count") > limit)
    hot = F.broadcast(staged(counts.select("key", F.ceil(F.col("count") / limit).alias("parts")), "hot-texts"))  # fewer than 1 / HOT_SHARE rows
    index = distinct_texts(docs)
    lists = lambda df: df.groupBy("key").agg(entry("text").alias("entry"))
    # a left join stays above the grouping, so that both branches read one shuffle of texts
    cold = rows.join(hot, "key", "left_anti").join(lists(index.join(hot, "key", "left").where("parts is null")), "key")
    parts = lists(index.join(hot, "key")).join(hot, "key").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = rows.join(hot, "key").withColumn("part", F.pmod(F.monotonically_increasing_id(), "parts")).drop("parts")
    return cold.select("doc_id", "entry.*").unionAll(dealt.join(parts, ["key", "part"]).select("doc_id", "entry.*"))


# ---- documents ---------------------------------------------------------------------------
def _draws(seed: int) -> list[Column]:
    """Four whole numbers below 2^32 from a document's id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def rearrange(docs: DataFrame, seed: int = 1) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` per row of ``docs``.

    n counts the tokens of the whole text. The document's draws pick two borders, and so its
    prefix, middle and suffix, which ``output`` has in the order prefix, suffix, middle (form
    ``psm``) or suffix, prefix, middle (``spm``), each behind its mark. Texts that are empty or
    hold a mark, and one of ten others, stay as they are (``plain``), without lengths. Null is the
    empty text; a null doc_id draws like an empty one, repeated rows alike; an empty table gives an
    empty result. Columns but doc_id and text are ignored, whatever their names.
    """
    h1, h2, h3, h4 = _draws(seed)
    n, text = F.col("n").cast("long") - 1, F.col("text")
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains(text, F.lit(mark))
    plain = (n == 0) | marked | (h3 % 100 >= REARRANGED)
    form = F.when(plain, "plain").when(h4 % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    rows = _joined(docs).withColumns({"form": form, "_i": F.when(~plain, F.least(h1 % (n + 1), h2 % (n + 1))), "_j": F.when(~plain, F.greatest(h1 % (n + 1), h2 % (n + 1)))})
    rows = rows.withColumn("cut", selected("width", "low", "high", "_i", "_j"))
    first, second = F.col("cut.first"), F.col("cut.second")
    prefix, middle = F.substring(text, F.lit(1), first), F.substring(text, first + 1, second - first)
    suffix = F.substring(text, second + 1, F.length(text))
    output = (
        F.when(F.col("form") == "plain", text)
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    return rows.select("doc_id", n.alias("n"), "form", first.alias("prefix_chars"), (second - first).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``rearrange`` made ``output`` of."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    part = lambda i: F.element_at(parts, i)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(2), part(4), part(3))).otherwise(F.concat(part(3), part(4), part(2)))


def op11_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rearrange(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP11_SQL = r"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
           sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS digest
    FROM documents
), drawn AS (
    SELECT *, len(tokens)::BIGINT AS n, ('0x' || digest[1:8])::BIGINT AS h1, ('0x' || digest[9:16])::BIGINT AS h2,
           ('0x' || digest[17:24])::BIGINT AS h3, ('0x' || digest[25:32])::BIGINT AS h4
    FROM docs
), formed AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
           CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), parts AS (
    SELECT *, array_to_string(tokens[1:i], '') AS prefix, array_to_string(tokens[i + 1:j], '') AS middle, array_to_string(tokens[j + 1:], '') AS suffix
    FROM formed
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
