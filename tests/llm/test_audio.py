import zlib

import numpy as np
from pyspark.sql import functions as F

from tapeloom.llm import audio as A


def sound(seed, seconds=2.0):
    rng = np.random.default_rng(seed)
    t = np.arange(int(A.RATE * 0.25)) / A.RATE
    notes = [sum(np.sin(2 * np.pi * 220 * 2 ** (n / 12) * t) for n in rng.choice(24, 3, replace=False)) for _ in range(int(seconds / 0.25))]
    x = np.concatenate(notes)
    return np.clip(128 + 35 * x + rng.normal(0, 1, len(x)), 0, 255).astype(np.uint8)


def brute_integers(frames):
    out = []
    for at in range(len(frames) - A.SPAN + 1):
        f, value = frames[at : at + A.SPAN].astype(float), 0
        for kind, p, dp, t, dt in A.FILTERS:
            box = f[t : t + dt, p : p + dp]
            h, w = dt // 2, dp // 2
            part = {"pitch": box[:, :w].sum(), "time": box[:h].sum(), "cross": box[:h, :w].sum() + box[h : 2 * h, w : 2 * w].sum(), "band": box[:, dp // 3 : 2 * (dp // 3)].sum() * 1.5, "pulse": box[dt // 4 : dt // 4 + h].sum()}[kind]
            share = (2 * part - box.sum()) / max(box.sum(), 1)
            level = int(share > -A.STEP[kind]) + int(share > 0) + int(share > A.STEP[kind])
            value = value << 2 | (level ^ level >> 1)
        out.append(value)
    return out


def test_integral_image_matches_plain_sums():
    frames = np.random.default_rng(1).integers(0, 9000, (30, 12))
    assert A.integers(frames).tolist() == brute_integers(frames)


def test_pitch_classes():
    t = np.arange(A.RATE) / A.RATE
    x = (100 * np.sin(2 * np.pi * 880 * t)).astype(np.float32)
    n = (len(x) - A.WINDOW) // A.HOP + 1
    c = A.chroma(x, np.arange(n) * A.HOP)
    assert (c.argmax(1) == 0).all() and abs(c.sum(1) - 65536).max() < 12  # A is the first class


def test_one_at_a_time_or_many():
    many = [sound(i, 0.5 + i / 4).tobytes() for i in range(6)] + [b"", None, b"x" * 400]
    for (a, u), b in zip(A.prints_of(many), many, strict=True):
        x, v = A.prints_of([b])[0]
        assert np.array_equal(a, x) and np.array_equal(u, v)


def test_alignment_finds_copies_cuts_and_noise(spark):
    base = [sound(i, 3) for i in range(5)]
    rng = np.random.default_rng(8)
    noisy = np.clip(base[0] + rng.normal(0, 2, len(base[0])), 0, 255).astype(np.uint8)
    rows = [(10 + i, x.tobytes()) for i, x in enumerate(base)]
    rows += [(20, base[1][A.HOP * 12 :].tobytes()), (21, noisy.tobytes()), (22, base[2].tobytes()), (23, base[2].tobytes()), (30, None), (31, b""), (32, b"short"), (32, b"short"), (None, base[3].tobytes())]
    media = spark.createDataFrame(rows, "id long, pcm binary").selectExpr("*", "1 as items", "2 as digest")
    got = {}
    for r in A.match_recordings(media).collect():
        got.setdefault(r.id, r)
        x = A.fingerprint(dict((k, v) for k, v in rows)[r.id])
        assert r.n_items == len(x) and r.fingerprint_crc32 == zlib.crc32(",".join(f"{v & 0xFFFFFFFFFFFFFFFF:X}" for v in x.view(np.int32).tolist()).encode())
    assert {k: got[k].class_id for k in (10, 11, 12, 13, 14, 20, 21, 22, 23, None)} == {10: 10, 11: 11, 12: 12, 13: 13, 14: 14, 20: 11, 21: 10, 22: 12, 23: 12, None: 13}
    assert (got[20].aligned_with, got[20].shift, got[21].aligned_with, got[21].shift) == (11, 12, 10, 0)
    x, y = A.fingerprint(rows[1][1]), A.fingerprint(rows[5][1])
    assert (got[20].start, got[20].overlap, got[20].bit_errors) == (0, len(y), 0) and 0 < got[20].votes <= len(y) - A.RUN + 1
    assert np.array_equal(x[12:], y) and got[21].overlap > 20 and 0 < got[21].bit_errors <= got[21].overlap * 32 * A.MAX_ERROR
    # equal recordings without integers share a class, null and empty count as equal
    assert (got[30].class_id, got[31].class_id, got[32].class_id, got[30].n_items) == (30, 30, 32, 0)
    assert A.match_recordings(media.limit(0)).collect() == []


def brute_agreement(x, y, shift):
    best = (0.0, 0, 0)
    for i in range(len(x)):
        errors = 0
        for j in range(i, len(x)):
            if not (0 <= i + shift and j + shift < len(y)):
                break
            errors += bin(int(x[j]) ^ int(y[j + shift])).count("1")
            best = max(best, ((j - i + 1) * 8 - errors, -i, j - i + 1, errors)[:3] + (errors,), key=lambda b: b[0])
    return best


def test_agreement_counts_all_thirty_two_bits():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**32, 40, np.uint32)
    y = x.copy()
    y[:5], y[30:] = rng.integers(0, 2**32, 5, np.uint32), rng.integers(0, 2**32, 10, np.uint32)
    y[17] ^= np.uint32(1 << 31)  # the top bit alone
    start, n, errors = A.agreement(x[5:30], y[5:30], 0)
    assert (start, n, errors) == (0, 25, 1)
    for shift in (-3, 0, 4):
        z = np.concatenate((rng.integers(0, 2**32, 10, np.uint32), y))[10 - shift :] if shift > 0 else y[-shift:]
        start, n, errors = A.agreement(z, x, -shift)
        gain, i, length, e = brute_agreement(z, x, -shift)
        assert abs(n * 8 - errors - gain) < 1e-9 and n >= 20 and errors >= 1
    assert A.agreement(x[:3], y[:3], 7) == (0, 0, 0)


def as_prints(spark, rows):
    return spark.createDataFrame([(k, x.tolist(), [True] * len(x)) for k, x in rows], "id long, items array<int>, varied array<boolean>")


def test_a_passage_held_in_order_by_later_recordings_only(spark):
    """Recording 1 holds a passage's integers, but scattered; 2 and 3 hold it in order."""
    rng = np.random.default_rng(4)
    passage = rng.integers(-(2**31), 2**31, 40)
    noise = lambda n: rng.integers(-(2**31), 2**31, n)
    one = np.ravel(np.column_stack((passage, noise(40))))
    two, three = np.concatenate((noise(9), passage, noise(5))), np.concatenate((passage, noise(12)))
    got = A.alignments(as_prints(spark, ((1, one), (2, two), (3, three)))).collect()
    assert [(r.id, r["with"], r.shift, r.votes, r.start, r.overlap, r.bit_errors) for r in got] == [(3, 2, 9, 39, 0, 40, 0)]


def test_holders_that_one_refuses_are_compared_with_each_other(spark):
    """Recordings 1 and 2 hold pairs of a passage's integers and no more; 3, 4 and 5 hold all."""
    rng = np.random.default_rng(6)
    noise = lambda n: rng.integers(-(2**31), 2**31, n)
    passage = noise(6)
    pairs = lambda: np.concatenate([np.concatenate((passage[i : i + 2], noise(3))) for i in range(5)])
    rows = [(1, pairs()), (2, pairs()), *((k, np.concatenate((noise(k), passage, noise(9)))) for k in (3, 4, 5))]
    got = {(r.id, r["with"]) for r in A.alignments(as_prints(spark, rows)).collect()}
    assert got == {(4, 3), (5, 3)}


def test_no_partner_is_lost_to_earlier_holders(spark):
    """2 and 3 are near copies; three earlier recordings hold a third of the clip each."""
    rng = np.random.default_rng(5)
    noise = lambda n: rng.integers(-(2**31), 2**31, n)
    clip = noise(30)
    rows = [(k, np.concatenate((noise(50), clip[10 * k : 10 * k + 10]))) for k in range(3)] + [(7, clip), (8, np.concatenate((clip[:15], noise(1), clip[15:])))]
    pairs = {(r.id, r["with"]) for r in A.alignments(as_prints(spark, rows)).collect()}
    assert {a for a, _ in pairs} == {7, 8} and {b for _, b in pairs} >= {0, 1, 2}


def test_silence_and_steady_tones_align_nothing(spark):
    quiet, t = np.full(A.RATE // 2, 128, np.uint8), np.arange(A.RATE) / A.RATE
    tone = np.rint(128 + 60 * np.sin(2 * np.pi * 440 * t)).astype(np.uint8)
    rows = [(k, np.concatenate((sound(100 + k, 1.5), quiet, tone, sound(200 + k, 1.5))).tobytes()) for k in range(20)]
    rows += [(20 + k, (word * 900).encode()) for k, word in enumerate(("der ", "retionly ", "oneaea. ", "zuß ", "erü, "))]
    media = spark.createDataFrame(rows, "id long, pcm binary")
    assert {r.class_id for r in A.match_recordings(media.where("id < 20")).collect()} == set(range(20))
    assert {r.class_id for r in A.match_recordings(media.where("id >= 20"), A.melody).collect()} == set(range(20, 25))


def shared_runs(texts, n):
    """Pairs of ids whose texts have ``n`` words in a row in common, among which are several: one
    word again and again is a steady sound."""
    held, out = {}, set()
    for d, text in texts.items():
        words = text.lower().split()
        for i in range(len(words) - n + 1):
            run = tuple(words[i : i + n])
            if len(set(run)) > n // 4:
                held.setdefault(hash(run), set()).add(d)
    for ids in held.values():
        ids = sorted(ids)
        out.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    return out


def test_recall_and_precision_against_the_texts(spark):
    sf = "/root/testdata/sf0.1"
    firsts = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        firsts[r.text] = min(r.doc_id, firsts.get(r.text, r.doc_id))
    texts = {d: t for t, d in firsts.items()}
    got = {r.doc_id: r for r in A.op4_audio(spark, sf).where(F.col("doc_id").isin(list(texts))).collect()}
    for words, recall in ((64, 0.98), (100, 0.99)):
        want = shared_runs(texts, words)
        assert len(want) > 100 and sum(got[a].class_id == got[b].class_id for a, b in want) >= recall * len(want)
    aligned = [(d, r.aligned_with) for d, r in got.items() if r.aligned_with is not None]
    grams = lambda d: {tuple(w) for words in [texts[d].lower().split()] for w in zip(*(words[i:] for i in range(16)))}
    false = [(a, b) for a, b in aligned if not grams(a) & grams(b)]
    assert len(aligned) > 300 and len(false) <= 0.06 * len(aligned)


def test_melody():
    text = b"one two three four five six seven. " * 9
    assert A.melody(None) == A.melody(b" \t") == b""
    assert len(A.melody(b"word")) == A.HOP and len(A.melody(text)) % A.HOP == 0
    rests = [w for w in (b"stop%d." % i for i in range(20)) if A._TONES[w] >= 256]
    head, tail = rests[0], b" ".join(b"w%d" % i for i in range(90))
    x, y = (np.frombuffer(A.melody(h + b" " + head + b" " + tail), np.uint8) for h in (b"a b c", b"a b c d e f g h i"))
    assert np.array_equal(x[A.HOP :], y[2 * A.HOP :])  # after the rest both are in step


def test_query(spark, sf):
    got = A.op4_audio(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(texts)
    first = {}
    for d in sorted(texts):
        first.setdefault(texts[d], d)
    by = {r.doc_id: r.class_id for r in got}
    assert all(by[d] == by[first[t]] for d, t in texts.items())


def test_places_are_dealt_by_run_once(spark):
    """Longer runs are looked up at the places that hold a refused run, not dealt out anew."""
    rng = np.random.default_rng(5)
    same = rng.integers(0, 9, 40).tolist()
    rows = [(i, (rng.integers(0, 9, 30).tolist() + same)[: 50 + i], [True] * (50 + i)) for i in range(20)]
    prints = spark.createDataFrame(rows, "id long, items array<int>, varied array<boolean>")
    at = A.places(prints).where("run % 3 = 0").select("id", "place")
    got = sorted((r.id, r.place, r.run) for r in A.longer_places(prints, at).collect())
    held = {(r.id, r.place) for r in at.collect()}
    want = [(r.id, r.place, r.run) for r in A.places(prints, A.RUN + 1).collect() if {(r.id, r.place), (r.id, r.place + 1)} & held]
    assert got == sorted(want)
    plan = A._shared(A.places(prints))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
