import random

import numpy as np
import pytest

from tapeloom.operators import model as M
from tapeloom.plans.model_queries import demo_int8, demo_weights
from tapeloom.sources import dumps as U
from tapeloom.sources import itch as I


def sample(n, seed=1):
    rng, rows = random.Random(seed), []
    for _ in range(n):
        kind = rng.choice("RAFECXDUPHSIQ")
        r = {"msg_type": kind, "locate": rng.randint(0, 20_000), "ts_ns": rng.choice([rng.randint(0, 2**47), 2**48 - 1])}
        if kind == "R":
            r["symbol"] = rng.choice(["AAPL", "A", "ZVZZT", " LEAD"])
        if kind in "AFP":
            r["symbol"] = "MSFT"
        if kind in "AFECXDUP":
            r["ref"] = rng.choice([rng.randint(0, 2**62), 2**64 - 1])
        if kind == "U":
            r["new_ref"] = rng.randint(0, 2**62)
        if kind in "AFP":
            r["side"] = rng.choice("BS")
        if kind in "AFPECXU":
            r["shares"] = rng.choice([0, 5, 2**32 - 1])
        if kind in "AFPU":
            r["price"] = rng.choice([1, 2**31 + 7, 2**32 - 1])
        if kind == "H":
            r["state"] = rng.choice("HPQT")
        rows.append(r)
    return rows


def signed(v):
    return v if v is None or v < 2**63 else v - 2**64


@pytest.mark.parametrize("split", [1 << 25, 5000, 997])
def test_itch_round_trip_over_splits(spark, tmp_path, split):
    rows = sample(3000)
    path = tmp_path / "day.itch"
    path.write_bytes(I.encode(rows) + b"\x00\x24A")  # and a message that is cut off
    spark.dataSource.register(I.ItchSource)
    got = spark.read.format("itch").option("path", str(path)).option("splitBytes", split).load().orderBy("seq").collect()
    names = ["msg_type", "locate", "ts_ns", "symbol", "ref", "new_ref", "side", "shares", "price", "state"]
    want = [tuple(signed(r.get(n)) if n in ("ref", "new_ref") else r.get(n) for n in names) for r in rows]
    assert [tuple(g[n] for n in names) for g in got] == want


def plain_frames(data):
    """(ordinal, body) of every whole frame, and what is left."""
    out, at = [], 0
    while at + 2 <= len(data) and at + 2 + int.from_bytes(data[at : at + 2], "big") <= len(data):
        size = int.from_bytes(data[at : at + 2], "big")
        out.append((len(out), data[at + 2 : at + 2 + size]))
        at += 2 + size
    return out, len(data) - at


@pytest.mark.parametrize("split", [60, 997, 10_000, 1 << 25])
def test_unknown_types_short_frames_and_a_cut_tail_at_any_split(spark, tmp_path, split):
    """An unlisted type every eleventh message, frames below a header, a tail cut off."""
    rng, parts = random.Random(5), []
    for i, r in enumerate(sample(2200)):
        if i % 11 == 0:
            body = b"z" + bytes(rng.randrange(256) for _ in range(rng.choice((10, 17, 70, 3000))))
            parts.append(len(body).to_bytes(2, "big") + body)
        elif i % 97 == 0:
            parts.append(rng.choice((b"\x00\x00", b"\x00\x03Sxx")))
        else:
            parts.append(I.encode([r]))
    data = b"".join(parts) + b"\x00\x24A"
    (tmp_path / "feed").mkdir()
    for name in ("a.itch", "b.itch"):
        (tmp_path / "feed" / name).write_bytes(data if name < "b" else data[:5000])
    spark.dataSource.register(I.ItchSource)
    found = I.index_frames(spark, str(tmp_path / "feed"), str(tmp_path / "index"), split)
    counters = {r.path.rsplit("/", 1)[1]: (r.frames, r.short_frames, r.leftover_bytes) for r in I.frame_counters(found).collect()}
    read = spark.read.format("itch").option("path", str(tmp_path / "feed"))
    for df in (read.option("index", str(tmp_path / "index")).load(), read.option("splitBytes", split).load()):
        got = {}
        for r in df.collect():
            got.setdefault(r.file, []).append((r.seq, r.msg_type, r.locate))
        for name, own in (("a.itch", data), ("b.itch", data[:5000])):
            whole, left = plain_frames(own)
            want = [(n, chr(b[0]), int.from_bytes(b[1:3], "big")) for n, b in whole if len(b) >= I.HEADER]
            assert sorted(got[name]) == want
            assert counters[name] == (len(whole), sum(len(b) < I.HEADER for _, b in whole), left)


def test_pushed_filters(spark, tmp_path):
    rows = sample(500)
    path = tmp_path / "day.itch"
    path.write_bytes(I.encode(rows))
    spark.dataSource.register(I.ItchSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("itch").option("path", str(path)).option("pushFilters", "true").load()
        one = rows[7]["locate"]
        assert df.where(f"locate = {one} and seq >= 0").count() == sum(r["locate"] == one for r in rows)
        some = df.where("msg_type in ('A', 'U')")
        assert some.count() == sum(r["msg_type"] in "AU" for r in rows)
        assert ") Filter" not in some._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_itch_filters_and_short_frames(spark, tmp_path):
    rows = sample(400)
    path = tmp_path / "day.itch"
    path.write_bytes(I.encode(rows[:200]) + b"\x00\x03Sxx" + b"\x00\x00" + I.encode(rows[200:]))
    spark.dataSource.register(I.ItchSource)
    read = spark.read.format("itch").option("path", str(path))
    assert read.load().count() == 400
    assert read.option("types", "AF").load().count() == sum(r["msg_type"] in "AF" for r in rows)
    one = rows[7]["locate"]
    assert read.option("types", "").option("locate", one).load().count() == sum(r["locate"] == one for r in rows)


def test_itch_to_books(spark, tmp_path):
    """The whole way: bytes, messages, orders, books."""
    from tapeloom.operators import book as B

    rows = [{"msg_type": "R", "locate": 3, "symbol": "AAPL"}]
    for i in range(300):
        rows.append({"msg_type": "A", "locate": 3 + i % 2, "ts_ns": i, "ref": i, "side": "BS"[i % 3 % 2], "shares": 10 + i, "price": 1000 + (i * 37) % 50})
        if i % 4 == 3:
            rows.append({"msg_type": "XDEU"[i // 4 % 4], "locate": 3 + (i - 1) % 2, "ts_ns": i, "ref": i - 1, "new_ref": 10_000 + i, "shares": 5, "price": 1010})
    path = tmp_path / "x.itch"
    path.write_bytes(I.encode(rows))
    spark.dataSource.register(I.ItchSource)
    m = spark.read.format("itch").option("path", str(path)).option("splitBytes", 3000).load().withColumn("locate", __import__("pyspark.sql.functions", fromlist=["col"]).col("locate").cast("long"))
    out = B.order_books(m).where("last_leg").collect()
    assert len(out) == len(rows) - 1 and {r.status for r in out} == {"ok"}


def test_dump_round_trip(spark, tmp_path):
    spark.dataSource.register(U.FeatureDump)
    rows = [(i, 100 - i, i - 5, [float(i) / (k + 1) for k in range(16)]) for i in range(1000)]
    df = spark.createDataFrame(rows, U.SCHEMA).repartition(3)
    path = str(tmp_path / "dump")
    df.write.format("featuredump").mode("append").option("path", path).save()
    back = spark.read.format("featuredump").option("path", path).load()
    same = lambda d: sorted((r.ts_ns, r.mid, r.spread, tuple(np.float32(r.f))) for r in d.collect())
    assert same(back) == same(df)
    bad = tmp_path / "bad.bin"
    bad.write_bytes(b"\x00" * 88)
    with pytest.raises(Exception, match="magic"):
        spark.read.format("featuredump").option("path", str(bad)).load().count()


def test_weight_files():
    w, q = demo_weights(), demo_int8()
    data, small = U.dump_weights(w), U.dump_int8(q)
    assert len(data) == 6944 and len(small) == 2072
    x = np.random.default_rng(0).normal(size=(50, 16)).astype(np.float32)
    assert np.array_equal(U.load_weights(data).forward(x), w.forward(x)) and np.array_equal(U.load_int8(small).forward(x), q.forward(x))
    for broken, message in ((data[:-1], "b4 is cut off"), (data + b"x", "1 bytes follow"), (b"abcd" + data[4:], "magic"), (data[:4] + b"\x09" + data[5:], "version"), (data[:8] + b"\x01" + data[9:], "layers")):
        with pytest.raises(ValueError, match=message):
            U.load_weights(broken)


def test_quantize_edges():
    f = np.float32
    for v, want in ((0.5, 0), (1.5, 2), (2.5, 2), (-0.5, 0), (-2.5, -2), (0.49999997, 0), (126.5, 126), (127.5, 127), (1e9, 127), (-1e9, -127), (float("nan"), -127), (float("inf"), -127), (-float("inf"), -127), (2.0**63, -127), (2.0**62, 127)):
        assert M.quantize_array(np.array([v], f), f(1))[0] == want, v
    sweep = np.arange(-150, 150, 0.25).astype(f)
    want = [max(-127, min(127, round(float(v)))) for v in sweep]
    assert M.quantize_array(sweep, f(1)).tolist() == want


def test_quantize_column_equals_the_array_form(spark):
    from pyspark.sql import functions as F

    from tapeloom.functions import market as m

    values = [float(v) for v in np.arange(-140, 140, 0.25)] + [float("nan"), 1e30, -1e30]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.q for r in df.select(m.quantize(F.col("v"), F.lit(1.0)).alias("q")).collect()]
    assert got == M.quantize_array(np.array(values, np.float32), np.float32(1)).tolist()


def test_batches_of_any_size_score_alike():
    q = demo_int8()
    x = np.random.default_rng(2).normal(size=(1000, 16)).astype(np.float32)
    whole = q.forward(x)
    for n in (1, 7, 15, 16, 17, 31, 32, 64, 100, 255, 256):
        assert np.array_equal(np.concatenate([q.forward(x[i : i + n]) for i in range(0, 1000, n)]), whole)


def test_training_learns(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    y = (x[:, 0] > 0.5).astype(int) + (x[:, 1] > 0).astype(int)
    w, accuracy = M.train(x[:2400], y[:2400], x[2400:], y[2400:], epochs=20, batch=64)
    assert accuracy > 0.85
    q = M.Int8Weights.of(w, [np.abs(a).max() / 127 for a in w.hidden(x[:500].astype(np.float32))])
    assert (q.forward(x).argmax(1) == w.forward(x.astype(np.float32)).argmax(1)).mean() > 0.97
    rough, fine = M.Codes.of(w.w0).report(w.w0), M.Codes.of(w.w0, 1).report(w.w0)
    assert fine["relative"] <= rough["relative"] < 0.02 and fine["largest"] <= rough["largest"]
    assert (M.Codes.of(np.zeros((2, 3)), 1).size == 1).all() and M.Codes.of(np.zeros((2, 3))).steps.max() == 0


def test_backends_take_their_own_weights(spark):
    rows = spark.createDataFrame([(1, [0.5] * 16)], "id long, f array<float>")
    a, b = (M.score(rows, w, backend=n).first().logits for w, n in ((demo_weights(), "float"), (demo_int8(), "int8")))
    assert a != b
    with pytest.raises(TypeError, match="Int8Weights"):
        M.score(rows, demo_weights(), backend="int8")
    with pytest.raises(TypeError):
        M.score(rows, demo_int8())
    with pytest.raises(ValueError, match="no backend"):
        M.score(rows, demo_weights(), backend="gpu")


def test_files_of_one_name_in_two_folders_are_told_apart(spark, tmp_path):
    spark.dataSource.register(I.ItchSource)
    for day, n in (("day1", 5), ("day2", 3)):
        (tmp_path / day).mkdir()
        (tmp_path / day / "all.bin").write_bytes(I.encode([{"msg_type": "D", "locate": 1, "ts_ns": i, "ref": i} for i in range(n)]))
    rows = spark.read.format("itch").load(str(tmp_path)).select("file", "seq").collect()
    assert sorted(map(tuple, rows)) == [("day1/all.bin", i) for i in range(5)] + [("day2/all.bin", i) for i in range(3)]


def test_large_files_ask_for_an_index(spark, tmp_path, monkeypatch):
    path = tmp_path / "all.bin"
    path.write_bytes(I.encode([{"msg_type": "D", "locate": 1, "ts_ns": i, "ref": i} for i in range(5)]))
    monkeypatch.setattr(I, "UNINDEXED_BYTES", 10)
    with pytest.raises(ValueError, match="index"):
        I.ItchReader({"path": str(path)}).partitions()
    I.index_frames(spark, str(path), str(tmp_path / "index"))
    assert len(I.ItchReader({"path": str(path), "index": str(tmp_path / "index")}).partitions()) == 1


@pytest.mark.parametrize("n", [1, 7, 15, 16, 17, 31, 32, 64, 100, 255, 256, 1000])
def test_float_forward_adds_in_order_in_batches_of_any_size(n):
    rng = np.random.default_rng(n)
    real = lambda *shape: rng.normal(size=shape).astype(np.float32)
    w = M.Weights(real(16), np.abs(real(16)) + np.float32(0.5), real(32, 16), real(32), real(32, 32), real(32), real(3, 32), real(3))
    f = real(n, 16)
    got = w.forward(f)
    for k in {0, n // 2, n - 1}:
        x = [(v - a) / b for v, a, b in zip(f[k], w.mean, w.std)]
        for weights, bias in ((w.w0, w.b0), (w.w2, w.b2), (w.w4, w.b4)):
            sums = []
            for j in range(len(bias)):
                total = bias[j]
                for i, v in enumerate(x):
                    total = np.float32(total + np.float32(v * weights[j, i]))
                sums.append(total)
            x = sums if len(bias) == 3 else [max(v, np.float32(0)) for v in sums]
        assert got[k].tobytes() == np.array(x, np.float32).tobytes()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tapeloom import staging

    class Path:
        def __init__(self, text):
            self.text = text

        def getFileSystem(self, _):
            return SimpleNamespace(makeQualified=lambda p: SimpleNamespace(toString=lambda: p.text))

    conf = {"spark.sql.warehouse.dir": "file:/work/warehouse"}
    hadoop = SimpleNamespace(apache=SimpleNamespace(hadoop=SimpleNamespace(fs=SimpleNamespace(Path=Path))))
    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)), sparkContext=SimpleNamespace(master="spark://host:7077"),
        _jvm=SimpleNamespace(org=hadoop), _jsparkSession=SimpleNamespace(sessionState=lambda: SimpleNamespace(newHadoopConf=lambda: None)),
    )
    with pytest.raises(ValueError, match="checkpoint"):
        staging.shared_dir(session)
    conf["spark.checkpoint.dir"] = "hdfs://store/shared"
    assert staging.shared_dir(session) == "hdfs://store/shared"


def test_flat_logits_keep_the_order_of_rows(spark, tmp_path):
    spark.dataSource.register(U.FlatLogits)
    rng = np.random.default_rng(2)
    rows = [(int(k), [float(v) for v in rng.normal(size=16).astype(np.float32)]) for k in rng.permutation(500)]
    scored = M.score(spark.createDataFrame(rows, "id long, f array<float>").repartition(7), demo_weights())
    path = str(tmp_path / "logits")
    scored.repartitionByRange(5, "id").sortWithinPartitions("id").select("logits").write.format("flatlogits").mode("append").save(path)
    files = sorted((tmp_path / "logits").glob("*.f32"))
    flat = np.concatenate([np.fromfile(f, "<f4") for f in files]).reshape(-1, 3)
    want = np.array([r.logits for r in scored.orderBy("id").collect()], np.float32)
    assert len(files) > 1 and flat.tobytes() == want.tobytes()
    (tmp_path / "one.f32").write_bytes(flat.tobytes())  # one flat file, as another program writes it
    for source in (path, str(tmp_path / "one.f32")):
        got = spark.read.format("flatlogits").load(source).orderBy("row").collect()
        assert [r.row for r in got] == list(range(500)) and np.array([r.logits for r in got], np.float32).tobytes() == flat.tobytes()
    with pytest.raises(Exception, match="has files already"):
        scored.select("logits").write.format("flatlogits").mode("append").save(path)
    (tmp_path / "cut.f32").write_bytes(flat.tobytes()[:-4])
    with pytest.raises(Exception, match="whole rows"):
        spark.read.format("flatlogits").load(str(tmp_path / "cut.f32")).collect()
    with pytest.raises(Exception, match="3 logits"):
        spark.createDataFrame([([1.0],)], "logits array<float>").write.format("flatlogits").mode("append").save(str(tmp_path / "odd"))
