import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tapeloom.llm import packing as P

PATH = P.default_tokenizer()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def plain_best_fit(counts, capacity):
    bins = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [i for i, s in enumerate(bins) if s >= length]
            if fit:
                bins[min(fit, key=lambda i: bins[i])] -= length
            else:
                bins.append(capacity - length)
    return len(bins)


def test_word_ids_equal_the_tokenizer(tokenizer, spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["", "  ", "It's we'll THEY'VE 'd I'M", "a1b²c³ ½x", "naïve ÀÉÎ ßÿ µm ªº", "école  x y", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>",
              "日本語 text ΑΣ ΣΑΣ İstanbul", "a\x1cb\x85c\x00d", "soft­hyphen ﻿bom", "x" * 3000, "!!!??? *** a's'S", "\x7f\x80\x9f", "１２ ٣ ④"]
    words = P.WordCoder(PATH)
    for t in texts:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert words.ids(t.encode()) == struct.pack(f"<{len(ids)}I", *ids), t[:50]


def test_histogram_packing_is_valid_and_no_worse_than_best_fit():
    rng = random.Random(5)
    for trial in range(60):
        capacity = rng.choice([10, 17, 60, 100])
        counts = Counter(rng.randint(1, rng.choice([capacity, capacity // 2])) for _ in range(rng.randint(0, 120)))
        patterns = P.pack_lengths(dict(counts), capacity)
        placed = Counter()
        for pattern, n in patterns:
            assert n > 0 and sum(x * k for x, k in pattern) <= capacity
            for x, k in pattern:
                placed[x] += n * k
        assert placed == counts
        bins, bound = sum(n for _, n in patterns), -(-sum(x * k for x, k in counts.items()) // capacity)
        assert bound <= bins <= plain_best_fit(counts, capacity) + 1


def test_reduction_keeps_the_optimum():
    from functools import lru_cache

    def optimum(items, capacity):
        @lru_cache(None)
        def least(rest):
            if not rest:
                return 0
            j, others = rest[0], rest[1:]
            best = None

            def choose(at, space, picked):
                nonlocal best
                left = tuple(x for i, x in enumerate(others) if i not in picked)
                v = 1 + least(left)
                best = v if best is None else min(best, v)
                for i in range(at, len(others)):
                    if others[i] <= space:
                        choose(i + 1, space - others[i], picked | {i})

            choose(0, capacity - j, frozenset())
            return best

        return least(tuple(sorted(items, reverse=True)))

    rng = random.Random(9)
    for _ in range(60):
        capacity = rng.choice([12, 20, 31])
        items = [rng.randint(2, capacity) for _ in range(rng.randint(1, 9))]
        lengths = P.Lengths(Counter(items))
        fixed = P.dominance_reduction(lengths, capacity)
        rest = [x for x, n in lengths.count.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + optimum(tuple(rest), capacity) == optimum(tuple(items), capacity)


def check(got, docs, tokenizer, capacity):
    want = Counter()
    for d, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), capacity):
            part = ids[at : at + capacity]
            want[d, at // capacity, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


def test_query(spark, sf, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = P.op8_packing(spark, sf).collect()
    n = check(got, docs, tokenizer, P.CAPACITY)
    total = sum(r.length for r in got)
    assert n <= -(-total // P.CAPACITY) + 1


def test_odd_rows_and_sequences(spark, tokenizer):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b c"), (3, "one two three " * 40), (4, "word " * 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as piece")
    packed = P.pack_documents(docs, PATH, 16)
    check(packed.collect(), rows, tokenizer, 16)
    ids = [i for r in P.sequences(packed).collect() for i in r.ids]
    want = [i for _, t in rows for i in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]]
    assert Counter(ids) == Counter(want)
    assert P.pack_documents(docs.limit(0), PATH, 16).collect() == []


def test_words_and_whole_texts_give_the_same_ids(tmp_path):
    """A tokenizer file of another kind is never taken apart word by word."""
    import json

    path = P.default_tokenizer()
    known = P.WordCoder(path)
    parts = json.load(open(path, encoding="utf-8"))
    other = tmp_path / "other.json"
    parts["normalizer"] = None
    other.write_text(json.dumps(parts), encoding="utf-8")
    unknown = P.WordCoder(str(other))
    assert known.by_word and not unknown.by_word
    for text in ("It's a Test, 12½ x", "ÀÉ naïve <|endoftext|> don't", "日本 é   z", "a" * 3000 + " b"):
        for c in (known, unknown):
            want = c.tokenizer.encode(text, add_special_tokens=False).ids
            assert c.ids(text.encode()) == np.array(want, "<u4").tobytes()


def test_cache_stays_within_its_bytes(monkeypatch):
    monkeypatch.setattr(P, "CACHE_BYTES", 4000)
    c = P.WordCoder(P.default_tokenizer())
    text = " ".join(f"word{i} {i}x" for i in range(500))
    assert c.ids(text.encode()) == np.array(c.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert c.size <= 4000 + 2000 and len(c) + len(c.parts) < 40
