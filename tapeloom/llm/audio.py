"""Chroma audio fingerprints of a media column, and the alignment of recordings by them.

Sound becomes frames of twelve pitch classes; filters over an integral image of those frames
compare neighbouring areas, and sixteen of them, two bits each, make an integer per frame.
Runs of equal integers vote for the offset between two recordings, and bit errors decide: they
align if, at one of the offsets, enough frames in a row agree that a listener could tell from
others. Silence and held tones sound alike everywhere and are no evidence.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import discard, staged, table
from tapeloom.llm.components import connected_components

RATE = 8000
WINDOW = 512
HOP = 256
#: Hertz that count, and the frames an integer looks at.
LOW, HIGH = 110.0, 3520.0
SPAN = 4
#: Integers in a row that must be equal for two recordings to be compared at an offset.
RUN = 2
#: Share of differing bits that a frame may have on average where two recordings are said to
#: agree, and the varied frames that must: measured on texts as sound, README.
MAX_ERROR = 0.12
FRAMES = 3
#: A frame is varied if no pitch class has more than this share of what sounds around it, in the
#: frames of its integer and so many on both sides.
SHARE = 0.3
AROUND = 8
#: Filters, own choice: (kind, first pitch class, pitch classes, first frame, frames).
#: Kinds: ``pitch`` halves by pitch, ``time`` halves by time, ``cross`` a checkerboard,
#: ``band`` the middle third by pitch, ``pulse`` the middle half by time.
FILTERS = (
    ("pitch", 0, 4, 0, 4), ("pitch", 2, 8, 0, 3), ("pitch", 6, 6, 1, 3), ("pitch", 0, 12, 1, 2),
    ("time", 0, 3, 0, 4), ("time", 3, 3, 0, 4), ("time", 6, 3, 0, 4), ("time", 9, 3, 0, 4),
    ("cross", 0, 4, 0, 4), ("cross", 4, 4, 0, 4), ("cross", 8, 4, 0, 4), ("cross", 1, 10, 0, 2),
    ("band", 0, 6, 0, 4), ("band", 5, 6, 0, 4), ("pulse", 0, 6, 0, 4), ("pulse", 6, 6, 0, 4),
)
#: Differences of areas, as a share of their sum, at which a filter's outer levels start.
STEP = {"pitch": 0.10, "time": 0.08, "cross": 0.08, "band": 0.10, "pulse": 0.08}


@lru_cache
def pitch_matrix() -> np.ndarray:
    """(bins, 12): which pitch class each frequency bin sounds in."""
    hertz = np.arange(WINDOW // 2 + 1) * RATE / WINDOW
    out = np.zeros((len(hertz), 12))
    for i, f in enumerate(hertz):
        if LOW <= f <= HIGH:
            out[i, round(12 * np.log2(f / 440.0)) % 12] = 1
    return out


def chroma(samples: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(frames, 12) of the windows at ``starts``. A frame's classes sum to 2**16, in whole
    numbers, so that sums over areas are exact wherever a recording is computed."""
    window = np.hanning(WINDOW).astype(np.float32)
    bins = np.flatnonzero(pitch_matrix().any(1))
    own, matrix = slice(bins[0], bins[-1] + 1), pitch_matrix()[bins[0] : bins[-1] + 1]
    frames, c = np.lib.stride_tricks.sliding_window_view(samples, WINDOW), np.zeros((len(starts), 12))
    for at in range(0, len(starts), 512):
        spectrum = np.fft.rfft(frames[starts[at : at + 512]] * window, axis=1)[:, own]
        power = spectrum.real.astype(np.float64) ** 2 + spectrum.imag.astype(np.float64) ** 2
        c[at : at + 512] = power @ matrix
    total = c.sum(1, keepdims=True)
    return np.rint(np.where(total > 1, c / np.maximum(total, 1), 1 / 12) * 65536).astype(np.int64)


def integers(frames: np.ndarray) -> np.ndarray:
    """An unsigned 32-bit integer for each frame that has ``SPAN`` frames from it on."""
    n = len(frames) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13), np.int64)
    image[1:, 1:] = frames.cumsum(0).cumsum(1)

    def area(t, dt, p, dp):
        low, high = image[t : t + n], image[t + dt : t + dt + n]
        return high[:, p + dp] - low[:, p + dp] - high[:, p] + low[:, p]

    out = np.zeros(n, np.uint32)
    for kind, p, dp, t, dt in FILTERS:
        whole = area(t, dt, p, dp)
        if kind == "pitch":
            part = area(t, dt, p, dp // 2)
        elif kind == "time":
            part = area(t, dt // 2, p, dp)
        elif kind == "cross":
            part = area(t, dt // 2, p, dp // 2) + area(t + dt // 2, dt // 2, p + dp // 2, dp // 2)
        elif kind == "band":
            part = area(t, dt, p + dp // 3, dp // 3) * 1.5
        else:
            part = area(t + dt // 4, dt // 2, p, dp)
        share = (2 * part - whole) / np.maximum(whole, 1)
        level = (share > -STEP[kind]).astype(np.uint32) + (share > 0) + (share > STEP[kind])
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1))).astype(np.uint32)  # neighbours differ in one bit
    return out


def varied_frames(frames: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether what sounds around each frame, between the ends of its recording, is varied.
    Frames without any sound, whose classes are all equal, have none."""
    at = np.arange(len(frames))
    sound = frames * (frames.max(1) != frames.min(1))[:, None]
    upto = np.concatenate((np.zeros((1, 12), np.int64), sound.cumsum(0)))
    around = upto[np.minimum(last, at + SPAN + AROUND)] - upto[np.maximum(first, at - AROUND)]
    total = around.sum(1)
    return (total > 0) & (around.max(1) <= SHARE * total)


def prints_of(recordings: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Integers of 8-bit unsigned mono sound, and which of them are of varied frames; none if it
    is shorter than their span."""
    out = []
    sizes = np.array([len(r or b"") for r in recordings], np.int64)
    part = np.cumsum(sizes) // 1_000_000  # many short recordings at once, a long one alone
    for k in np.unique(part):
        own = np.flatnonzero(part == k)
        counts = np.maximum(0, (sizes[own] - WINDOW) // HOP + 1)
        ends = np.cumsum(counts)
        if not ends[-1]:
            out += [(np.zeros(0, np.uint32), np.zeros(0, bool))] * len(own)
            continue
        samples = np.frombuffer(b"".join([recordings[i] or b"" for i in own]), np.uint8).astype(np.float32) - 128
        first = np.repeat(ends - counts, counts)
        starts = np.repeat(np.cumsum(sizes[own]) - sizes[own], counts) + HOP * (np.arange(ends[-1]) - first)
        frames = chroma(samples, starts)
        found, varied = integers(frames), varied_frames(frames, first, np.repeat(ends, counts))
        spans = [slice(e - n, max(e - n, e - SPAN + 1)) for n, e in zip(counts, ends, strict=True)]
        out += [(found[x], varied[x]) for x in spans]
    return out


def fingerprint(pcm: bytes | None) -> np.ndarray:
    return prints_of([pcm])[0][0]


# ---- a text as sound ---------------------------------------------------------------------
#: Samples of a word's tone, and tones: two voices of twelve notes each.
WORD = 32
VOICES = 12


class _Tones(dict):
    """Word -> its tone, with 256 added where a rest follows; a word seen before costs a lookup."""

    def __missing__(self, word: bytes) -> int:
        code = zlib.crc32(word)
        tone = code % VOICES**2 + 256 * (word[-1:] in b".!?" and code >> 16 & 1)
        if len(self) >= 200_000:
            self.clear()
        self[word] = tone
        return tone


_TONES = _Tones()


@lru_cache
def tones() -> np.ndarray:
    """(tones, samples): a note of the octave from 440 Hz with one of the octave above."""
    t = np.arange(WORD) / RATE
    note = lambda f: np.sin(2 * np.pi * f * t)
    both = [note(440 * 2 ** (i / VOICES)) + note(880 * 2 ** (k / VOICES)) for i in range(VOICES) for k in range(VOICES)]
    return np.rint(128 + 50 * np.array(both)).astype(np.uint8)


def melody(text: bytes | None) -> bytes:
    """8-bit sound of a text: a tone to a word, and a rest until the next hop after every other
    sentence, its last word deciding. So a change leaves the frames beyond those as they are."""
    words = text.lower().split() if text else []
    if not words:
        return b""
    codes = np.fromiter(map(_TONES.__getitem__, words), np.int64, len(words))
    ends = np.flatnonzero(codes >= 256) + 1
    starts = np.concatenate(([0], ends))
    sizes = np.diff(np.concatenate((starts, [len(codes)])))
    beat = HOP // WORD
    room = -(-sizes // beat) * beat
    place = np.arange(len(codes)) + np.repeat(np.cumsum(room) - room - starts, sizes)
    out = np.full((int(room.sum()), WORD), 128, np.uint8)
    out[place] = tones()[codes % 256]
    return out.tobytes()


# ---- recordings --------------------------------------------------------------------------
def fingerprints(media: DataFrame, decode: Callable[[bytes | None], bytes | None] | None = None) -> DataFrame:
    """``media(id, pcm)`` -> ``id, digest, items, varied``: whole recordings, no shuffle.
    ``decode`` makes 8-bit sound of what the column holds, one recording after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, held, size = [], [], 0
            for value in b.column(2):
                sound = value.as_py() if decode is None else decode(value.as_py())
                held.append(sound)
                size += len(sound or b"")
                if size > 4_000_000:
                    found += prints_of(held)
                    held, size = [], 0
            found += prints_of(held) if held else []
            ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x, _ in found]))), pa.int32())
            items = np.concatenate([np.zeros(0, np.uint32), *[x for x, _ in found]]).view(np.int32)
            varied = np.concatenate([np.zeros(0, bool), *[v for _, v in found]])
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (items, varied)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["id", "digest", "items", "varied"])

    keyed = media.select(F.col("id").cast("long"), F.unhex(F.sha2(F.coalesce("pcm", F.lit(b"")), 256)).alias("digest"), "pcm")
    return keyed.mapInArrow(run, "id long, digest binary, items array<int>, varied array<boolean>")


def _hash_at(place: Column, run: int) -> Column:
    """The hash of the run of ``run`` integers from ``place`` on; null if one of them is of no
    varied frame, if none differs from the first, or beyond the last run."""
    each = [F.get("items", place + k) for k in range(run)]
    moves = reduce(or_, [x != each[0] for x in each[1:]], F.lit(run == 1))
    told = reduce(and_, [F.get("varied", place + k) for k in range(run)])
    return F.when(told & moves, F.xxhash64(*each))


def places(prints: DataFrame, run: int = RUN) -> DataFrame:
    """``prints(id, items, varied)`` -> ``id, place, run``: the hashed runs of ``run`` integers of
    varied frames that aren't all equal."""
    hashed = F.transform("items", lambda x, i: _hash_at(i, run))
    return prints.select("id", F.posexplode(hashed).alias("place", "run")).where("run is not null")


def longer_places(prints: DataFrame, at: DataFrame, run: int = RUN) -> DataFrame:
    """``id, place, run`` of the runs of one integer more that begin or end with the run at one
    of the places ``at(id, place)``."""
    each = at.groupBy("id").agg(F.collect_set("place").alias("at"))  # fewer than a recording's frames
    both = F.array_distinct(F.concat("at", F.transform("at", lambda p: p - 1)))
    longer = F.transform(both, lambda p: F.struct(p.alias("place"), _hash_at(p, run + 1).alias("run")))
    return prints.join(each, "id").select("id", F.explode(longer).alias("r")).select("id", "r.place", "r.run").where("run is not null")


def agreement(x: np.ndarray, y: np.ndarray, shift: int, max_error: float = MAX_ERROR) -> tuple[int, int, int]:
    """(first place in ``x``, places, bit errors) of the stretch where ``x`` and ``y``, shifted,
    agree best: the one that gains most if a frame gains ``max_error`` of its 32 bits and loses
    those that differ."""
    start = max(0, -shift)
    n = min(len(x) - start, len(y) - start - shift)
    if n < 1:
        return start, 0, 0
    errors = np.bitwise_count(x[start : start + n] ^ y[start + shift : start + shift + n]).astype(np.int64)
    gain = np.concatenate(([0.0], np.cumsum(32 * max_error - errors)))
    low = np.minimum.accumulate(gain[:-1])
    end = int(np.argmax(gain[1:] - low)) + 1
    begin = int(np.argmin(gain[:end]))
    return start + begin, end - begin, int(errors[begin:end].sum())


def decisions(prints: DataFrame, votes: DataFrame, max_error: float = MAX_ERROR, frames: int = FRAMES) -> DataFrame:
    """``votes(id, with, shift, votes)`` -> per pair ``id, with, shift, votes, start, overlap,
    bit_errors, told, aligned``: the offset at which most varied frames agree (more votes, then
    the nearest and smallest, of equals), and whether ``frames`` of them do."""
    pairs = votes.groupBy("id", "with").agg(F.collect_list(F.struct("shift", "votes")).alias("offsets"))  # fewer than a recording's frames
    mine = prints.select("id", F.col("items").alias("x"), F.col("varied").alias("u"))
    theirs = prints.select(F.col("id").alias("with"), F.col("items").alias("y"), F.col("varied").alias("v"))
    names = ["shift", "votes", "start", "overlap", "bit_errors", "told"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            columns = [b.column(c) for c in ("x", "u", "y", "v")]
            for i, offsets in enumerate(b.column("offsets").to_pylist()):
                x, u, y, v = (c[i].values.to_numpy(zero_copy_only=False) for c in columns)
                best = []
                for o in offsets:
                    shift = o["shift"]
                    start, n, errors = agreement(x.view(np.uint32), y.view(np.uint32), shift, max_error)
                    told = int((u[start : start + n] & v[start + shift : start + shift + n]).sum())
                    best.append((told, o["votes"], -abs(shift), -shift, (shift, o["votes"], start, n, errors, told)))
                found.append(max(best)[-1])
            out = [pa.array(c, pa.int32()) for c in np.array(found, np.int64).reshape(-1, 6).T]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("with"), *out], ["id", "with", *names])

    both = pairs.join(mine, "id").join(theirs, "with").select("id", "with", "offsets", "x", "u", "y", "v")
    return both.mapInArrow(run, "id long, with long, " + ", ".join(f"{n} int" for n in names)).withColumn("aligned", F.col("told") >= frames)


def _shared(live: DataFrame) -> DataFrame:
    """``id, place, run, with, at``: the places of runs that several recordings hold, with the
    run's first holder (smallest id and place). All places are dealt by run, once; a run that
    all recordings hold has a row for each of them, sorted with the others of its task."""
    own = Window.partitionBy("run")
    held = live.select("id", "place", "run", F.min(F.struct("id", "place")).over(own).alias("first"), F.max("id").over(own).alias("last"))
    return held.where("last <> first.id").select("id", "place", "run", F.col("first.id").alias("with"), F.col("first.place").alias("at"))


def _votes(shared: DataFrame) -> DataFrame:
    """``id, with, shift, votes``: the offset histogram of each recording against first holders."""
    held = shared.where(F.col("id") != F.col("with"))
    return held.groupBy("id", "with", (F.col("at") - F.col("place")).alias("shift")).agg(F.count("*").alias("votes"))


def alignments(prints: DataFrame, run: int = RUN, max_error: float = MAX_ERROR, frames: int = FRAMES) -> DataFrame:
    """The aligned pairs of ``prints(id, items, varied)``, ids distinct, that connect all others;
    columns as of ``decisions``.

    Each run's holders are compared with its first one, so that the rows grow with the recordings
    and not with their pairs, also for a passage that all share. Where bit errors refuse one,
    two holders may still align with each other: they share a run of one integer more, as
    a rule, whose first holder agrees with both in all of it. So the longer runs around
    refused ones vote once more, for all recordings that hold them.
    """
    shared = staged(_shared(places(prints, run)), "audio-shared")
    decided = staged(decisions(prints, _votes(shared), max_error, frames), "audio-decided")
    refused = decided.where("not aligned").select("id", "with")
    runs = shared.join(refused, ["id", "with"], "left_semi").select("run").distinct()
    votes = _votes(_shared(longer_places(prints, shared.join(runs, "run", "left_semi").select("id", "place"), run)))
    again = decisions(prints, votes.join(decided.where("aligned").select("id", "with"), ["id", "with"], "left_anti"), max_error, frames)
    return decided.where("aligned").unionAll(again.where("aligned"))


def match_recordings(media: DataFrame, decode: Callable | None = None, run: int = RUN, max_error: float = MAX_ERROR, frames: int = FRAMES) -> DataFrame:
    """One row per row of ``media(id, pcm)``: id, n_items, fingerprint_crc32, class_id (the
    smallest id that alignments reach), and of its alignments with smaller ids the one of most
    varied frames: aligned_with, shift (in hops), votes, start, overlap, bit_errors; null if it
    has none.

    Equal recordings are one class before anything is aligned. Null, empty and short ones have
    no integers and align with nothing, but equal ones still share a class; neither do silence
    and steady tones align, nor recordings that have nothing else in common. Rows with a null
    id take part in their class. An empty table gives an empty result. Columns but id and pcm
    are ignored, whatever their names; repeated ids keep their rows; long recordings are
    worked through like short ones, in memory that grows with one recording.
    """
    rows = staged(fingerprints(media, decode), "audio-prints")
    classes = rows.groupBy("digest").agg(F.min("id").alias("class"), F.any_value(F.struct("items", "varied")).alias("print"))
    classes = staged(classes.select("digest", "class", "print.*"), "audio-classes")
    prints = classes.where("class is not null").select(F.col("class").alias("id"), "digest", "items", "varied")
    if not prints.groupBy("id").count().where("count > 1").isEmpty():  # of recordings under one id the first by digest is aligned
        prints = prints.groupBy("id").agg(F.min_by(F.struct("items", "varied"), "digest").alias("print")).select("id", "print.*")
    prints = prints.drop("digest")
    links = staged(alignments(prints, run, max_error, frames), "audio-links")
    roots = staged(connected_components(links.select(F.col("id").alias("a"), F.col("with").alias("b"))), "audio-roots")
    best = links.groupBy("id").agg(F.max(F.struct("told", "votes", (-F.col("with")).alias("low"), "shift", "start", "overlap", "bit_errors")).alias("b"))
    best = best.select("id", (-F.col("b.low")).alias("aligned_with"), "b.shift", F.col("b.votes").cast("long").alias("votes"), "b.start", "b.overlap", "b.bit_errors")
    known = classes.select("digest", "class").join(roots, F.col("class") == F.col("node"), "left").join(best, F.col("class") == F.col("id"), "left")
    known = known.select("digest", F.coalesce("root", "class").alias("class_id"), "aligned_with", "shift", "votes", "start", "overlap", "bit_errors")
    known = staged(known, "audio-known")
    discard(classes, links, roots)
    crc = F.crc32(F.array_join(F.transform("items", lambda i: F.hex(i)), ",").cast("binary"))
    return rows.select("id", "digest", F.size("items").alias("n_items"), crc.alias("fingerprint_crc32")).join(known, "digest").drop("digest")


def op4_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no sound, so each document's whole text is played (``melody``): copies
    align in full, edited ones between their edits, documents that share a long passage in it."""
    docs = table(spark, sf_dir, "documents")
    out = match_recordings(docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("pcm")), melody)
    return out.withColumnRenamed("id", "doc_id")
