import heapq
import random
import zlib
from collections import Counter, defaultdict

from tapeloom.llm import sharding as S


def check(rows, got, shards):
    texts = defaultdict(set)
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    for r in got:
        texts[r.size, r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in texts.values())
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_query(spark, sf):
    got = S.op2_sharding(spark, sf).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, got, 24)
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    groups = Counter()
    for _, t in rows:
        groups[t] += len(t.encode()) + 8
    assert dict(loads) == plain_heap(groups.values(), 24)[0]
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def plain_heap(sizes, shards):
    heap, homes = [(0, s) for s in range(shards)], Counter()
    for size in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        homes[size, s] += 1
        heapq.heappush(heap, (load + size, s))
    return dict((s, load) for load, s in heap), homes


def test_runs_of_equal_sizes_equal_a_plain_heap():
    rng = random.Random(3)
    for shards in (1, 2, 7, 24):
        for _ in range(20):
            sizes = [rng.choice((0, 1, 2, 3, 5, 8, 13, 400)) if rng.random() < 0.9 else rng.randrange(5000) for _ in range(rng.randrange(1, 900))]
            heap, taken = S.Shards(shards), Counter()
            for size, n in sorted(Counter(sizes).items(), reverse=True):
                for s, k in enumerate(heap.deal(size, n).tolist()):
                    if k:
                        taken[size, s] += k
            loads, homes = plain_heap(sizes, shards)
            assert {s: load for load, s in heap.heap} == loads and taken == homes


def test_loads_equal_a_plain_heap_over_all_groups(spark):
    rows = [(i, "a" * (i * i % 97) + str(i % 1500)) for i in range(3000)] + [(9000 + i, "b" * 4000) for i in range(40)]
    got = S.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    loads, groups = Counter(), Counter()
    for r in got:
        loads[r.shard] += r.size
    for _, t in rows:
        groups[t] += len(t) + 8
    assert dict(loads) == plain_heap(groups.values(), 8)[0]


def test_odd_rows(spark):
    rows = [(1, "same"), (2, "same"), (2, "same"), (None, None), (3, ""), (None, "x"), (4, "y" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as `group`", "3 as size")
    check(rows, S.shard_documents(docs, 3).collect(), 3)
    assert S.shard_documents(docs.limit(0), 3).collect() == []
