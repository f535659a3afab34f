import random
import time
from collections import Counter

import pytest

from tapeloom.operators import book as B
from tapeloom.operators.fold import BOOK_COLUMNS, ORDER_SCHEMA, BookStage, OrderStage, symbol_fold
from tapeloom.sources import feeds, itch
from tapeloom.streaming import book_stream
from tapeloom.streaming.book_stream import StateDict, TreeBook, pack_node, unpack_node


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(book_stream.PROVIDER, None)
    spark.conf.set(book_stream.PROVIDER, book_stream.ROCKS)
    yield
    spark.conf.unset(book_stream.PROVIDER) if before is None else spark.conf.set(book_stream.PROVIDER, before)


def run_stream(spark, rows, schema, fold, tmp_path):
    """The fold over three files, a micro-batch each: two, and the last after a restart."""
    folder, out = tmp_path / "in", tmp_path / "out"
    for k in range(3):
        part = rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3]
        if k == 2:
            part = part + rows[:5]  # late ones, to be left out
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)
        if k:
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
            q = fold(stream).writeStream.format("parquet").option("path", str(out)).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            q.awaitTermination(240)
            assert q.exception() is None
    return spark.read.parquet(str(out))


def test_stream_equals_batch(spark, sf, tmp_path, rocks):
    updates = feeds.level_updates(spark, sf).selectExpr("seq", "locate", "ts_ns", "event_type", "side", "cast(price as bigint) price", "qty")
    got = run_stream(spark, updates.orderBy("seq").collect(), updates.schema, book_stream.stream_books, tmp_path)
    want = B.books(updates)
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_stream_of_orders_equals_batch(spark, sf, tmp_path, rocks):
    columns = ["seq", "locate", "ts_ns", "msg_type", "ref", "new_ref", "side", "shares", "price"]
    messages = feeds.order_messages(spark, sf).select(columns).where("locate < 8")
    got = run_stream(spark, messages.orderBy("seq").collect(), messages.schema, book_stream.stream_order_books, tmp_path)
    want = symbol_fold(messages, [OrderStage, BookStage], f"{ORDER_SCHEMA}, {BOOK_COLUMNS}")
    assert want.where("price is not null").count() > 100
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_stream_names_the_state_store_that_it_needs(spark, sf):
    with pytest.raises(ValueError, match="RocksDB"):
        book_stream.stream_books(feeds.level_updates(spark, sf))


class Store:
    """A map state of a dict that counts the bytes written."""

    def __init__(self):
        self.kept, self.written = {}, 0

    def getValue(self, key):  # noqa: N802
        return self.kept.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.kept[key] = value
        self.written += len(value[0])

    def removeKey(self, key):  # noqa: N802
        del self.kept[key]

    def clear(self):
        self.kept = {}


def test_tree_of_levels_is_the_book():
    """Random prices, also negative and far apart, in many small micro-batches, with clears."""
    rng, store, counts, want, most = random.Random(3), Store(), {"B": 0, "S": 0}, BookStage(), 0
    for _ in range(300):
        n = rng.randrange(1, 12)
        prices = [rng.choice([rng.randrange(-50, 50), rng.randrange(10**6), rng.randrange(2**34)]) for _ in range(n)]
        f = {"side": rng.choices("BS", k=n), "price": [None if rng.random() < 0.05 else p for p in prices], "qty": [rng.choice([0, 0, 5, 7]) for _ in range(n)], "action": [("clear" if rng.random() < 0.003 else None) for _ in range(n)]}
        nodes = StateDict(store, pack_node, unpack_node)
        got = TreeBook(nodes, counts)(f)
        nodes.flush()
        assert got == want(f)
        most = max(most, *counts.values())
    assert most > 40


def test_what_a_message_writes_does_not_grow_with_the_book():
    most = []
    for levels in (20_000, 100_000):  # nodes below the root are full at 256 entries
        store, counts = Store(), {"B": 0, "S": 0}
        nodes = StateDict(store, pack_node, unpack_node)
        book = TreeBook(nodes, counts)
        for k in range(levels):
            book.put("S", 10**6 + 7 * k, 3)
        nodes.flush()
        seen = []
        for k in (0, levels // 2, levels - 1):
            for qty in (9, 0, 4):
                nodes, store.written = StateDict(store, pack_node, unpack_node), 0
                TreeBook(nodes, counts).put("S", 10**6 + 7 * k, qty)
                nodes.flush()
                seen.append(store.written)
        most.append(max(seen))
    assert all(m <= len(book_stream.SHIFTS) * 256 * 16 for m in most)
    assert most[1] < 1.2 * most[0]


def test_each_message_of_growing_files_comes_once(spark, tmp_path):
    """Files that grow in the middle of a frame, new files, and a restart from the checkpoint."""
    spark.dataSource.register(itch.ItchSource)
    messages = [{"msg_type": "D", "locate": 1 + i % 3, "ts_ns": i, "ref": i} for i in range(40)]
    folder = tmp_path / "feed"
    folder.mkdir()
    data = itch.encode(messages[:20])

    def run():
        stream = spark.readStream.format("itch").option("splitBytes", 100).load(str(folder)).select("file", "seq", "ref")
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        return Counter(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))

    (folder / "a.bin").write_bytes(data[:-7])
    assert run() == {("a.bin", i, i): 1 for i in range(19)}
    (folder / "a.bin").write_bytes(data + itch.encode(messages[20:30]))
    (folder / "b.bin").write_bytes(itch.encode(messages[30:]))
    want = Counter({("a.bin", i, i): 1 for i in range(30)} | {("b.bin", i, 30 + i): 1 for i in range(10)})
    assert run() == want and run() == want
