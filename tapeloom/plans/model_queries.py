"""Queries of the model operators, on the embeddings' first sixteen components.

Weights follow a rule, in small whole numbers, and inputs are rounded to 64ths, so that float32
sums are exact in any order.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tapeloom.functions import market as m
from tapeloom.operators import dataset as D
from tapeloom.operators import model as M
from tapeloom.sources import feeds
from tapeloom.staging import staged

INT8_SCALES = (2.0**-5, 2.0**-1, 2.0**2)
WEIGHT_SCALES = (1.0, 0.5, 0.25)
#: Rows that networks are trained on, about, chosen by hash.
TRAIN_ROWS = 20_000


def rule(out: int, inp: int) -> np.ndarray:
    return np.array([[(7 * j + 3 * i) % 5 - 2 for i in range(inp)] for j in range(out)])


def demo_weights() -> M.Weights:
    return M.Weights(np.zeros(16), np.full(16, 2.0), rule(32, 16), np.arange(32) % 3 - 1, rule(32, 32), np.arange(32) % 5 - 2, rule(3, 32), np.array([1, 0, -1]))


def demo_int8() -> M.Int8Weights:
    w = demo_weights()
    return M.Int8Weights(w.mean, w.std, np.float32(INT8_SCALES), np.float32(WEIGHT_SCALES), w.w0.astype(np.int8), w.b0, w.w2.astype(np.int8), w.b2, w.w4.astype(np.int8), w.b4)


def _rows(spark, sf):
    f = F.transform(F.slice("embedding", 1, 16), lambda v: (F.rint(v * 64) / 64).cast("float"))
    return feeds.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), f.alias("f"), (F.col("label") % 3).alias("y"))


def _flat(scored):
    return scored.select("id", *[F.element_at("logits", k + 1).cast("double").alias(f"logit_{k}") for k in range(3)], "pred")


def forward_float(spark, sf):
    return _flat(M.score(_rows(spark, sf), demo_weights()))


def forward_int8(spark, sf):
    return _flat(M.score(_rows(spark, sf), demo_int8(), backend="int8"))


def argmax_class(spark, sf):
    scored = M.score(_rows(spark, sf), demo_weights())
    return scored.select("id", m.first_argmax(F.col("logits")).alias("pred"))


def checksum(spark, sf):
    scored = M.score(_rows(spark, sf), demo_int8(), backend="int8")
    return scored.agg(F.sum(F.element_at("logits", 1).cast("double")).alias("checksum"), F.count("*").alias("n"))


def diff_float_int8(spark, sf):
    rows = _rows(spark, sf)
    d = D.difference(M.score(rows, demo_weights()), M.score(rows, demo_int8(), backend="int8"))
    return d.select("n", F.round("max_gap", 6).alias("max_gap"), F.round("mean_gap", 6).alias("mean_gap"), F.round("max_relative", 6).alias("max_relative"), "worst_row", "class_changes", "equal_rows")


def model_accuracy(spark, sf):
    rows = _rows(spark, sf)
    scored = M.score(rows, demo_weights()).join(rows.select("id", "y"), "id")
    return scored.agg(F.count_if(F.col("y") == F.col("pred")).alias("hits"), F.count("*").alias("n"))


def round_trip(w: M.Weights, per_row: bool) -> M.Weights:
    """The weights as they are after quantisation to int8 and back."""
    back = {n: M.Codes.of(getattr(w, n), 1 if per_row else None).restored() for n in ("w0", "w2", "w4")}
    return M.Weights(w.mean, w.std, back["w0"], w.b0, back["w2"], w.b2, back["w4"], w.b4)


def quantized_accuracy(spark, sf):
    """Right answers with float weights, and with weights quantised by tensor and by row."""
    rows, w = _rows(spark, sf), demo_weights()
    ways = {"float": w, "tensor": round_trip(w, False), "row": round_trip(w, True)}
    out = None
    for name, weights in ways.items():
        hits = M.score(rows, weights).join(rows.select("id", "y"), "id").agg(F.lit(name).alias("weights"), F.count_if(F.col("y") == F.col("pred")).alias("hits"), F.count("*").alias("n"))
        out = hits if out is None else out.union(hits)
    return out


def quantize_values(spark, sf):
    e = feeds.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return e.select("vec_id", "i", m.quantize(F.col("v"), F.lit(0.03125)).alias("q"))


def weight_quantize(spark, sf):
    """Each vector as a tensor: largest magnitude over 127 is its scale, codes follow."""
    e = feeds.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("t"))
    scale = F.array_max(F.transform("t", lambda v: F.abs(v))) / 127
    e = e.withColumn("scale", F.when(scale == 0, 1.0).otherwise(scale))
    q = e.select("vec_id", "scale", "t", F.transform("t", lambda v: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(v / F.col("scale"))))).alias("q"))
    return q.select("vec_id", F.round("scale", 9).alias("scale"), F.aggregate("q", F.lit(0.0), lambda s, v: s + v).cast("long").alias("code_sum"), F.size(F.filter("q", lambda v: F.abs(v) == 127)).cast("long").alias("at_limit"))


def quantize_error(spark, sf):
    e = feeds.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("t"))
    e = e.withColumn("scale", F.array_max(F.transform("t", lambda v: F.abs(v))) / 127)
    gaps = F.transform("t", lambda v: F.abs(v - F.rint(v / F.col("scale")) * F.col("scale")))
    return e.select("vec_id", F.round(F.array_max(gaps), 9).alias("max_error"))


def activation_calibration(spark, sf):
    c = M.calibration(M.activations(_rows(spark, sf), demo_weights()), 0.9999)
    return c.select("point", F.round("largest", 6).alias("largest"), F.round("cutoff", 6).alias("cutoff"), F.round("scale", 6).alias("scale"), F.round("clipped", 9).alias("clipped"))


def _split_rows(spark, sf):
    return staged(D.chrono_split(_rows(spark, sf), "id"), "split-rows")


def _sample(rows, limit: int):
    """About ``limit`` rows at most, chosen by a hash of the id, for training: normalised
    training and validation rows, and the mean and deviation of the training ones."""
    n = rows.count()
    if n > limit:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) < limit)
    data = rows.select("id", "f", "y", "split").orderBy("id").toArrow()
    x, y, train = np.array(data.column("f").to_pylist(), np.float64).reshape(-1, M.INPUTS), data.column("y").to_numpy(), np.array(data.column("split").to_pylist()) == "train"
    val = np.array(data.column("split").to_pylist()) == "val"
    mean, std = (x[train].mean(0), x[train].std(0)) if train.any() else (np.zeros(M.INPUTS), np.ones(M.INPUTS))
    std = np.where(std == 0, 1, std)
    z = (x - mean) / std
    return (z[train], y[train], z[val], y[val]), mean, std


def _accuracy(rows, weights: list) -> list[float]:
    """Share of right answers of each network over all test rows: one scan of them."""

    def run(batches):
        for b in batches:
            f, y = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), b.column(1).to_numpy(zero_copy_only=False)
            hits = [int((w.forward(f).argmax(1) == y).sum()) for w in weights]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(hits)), pa.int32()), pa.array(hits, pa.int64()), pa.array([b.num_rows] * len(hits), pa.int64())], ["k", "hits", "n"])

    each = rows.where("split = 'test'").select(F.col("f").cast("array<float>"), F.col("y").cast("int")).mapInArrow(run, "k int, hits long, n long")
    found = {r.k: r.hits / r.n for r in each.groupBy("k").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect()}
    return [found.get(k, 0.0) for k in range(len(weights))]


def train_mlp(spark, sf, limit: int = TRAIN_ROWS):
    """Classes that a trained network gives all rows, and its accuracy over all test rows. The
    weights come from a sample of at most about ``limit`` training and validation rows."""
    rows = _split_rows(spark, sf)
    sample, mean, std = _sample(rows, limit)
    w = M.train(*sample, mean, std, epochs=4, batch=256)[0]
    accuracy = _accuracy(rows, [w])[0]
    return M.score(_rows(spark, sf), w).groupBy("pred").agg(F.count("*").alias("n")).withColumn("test_accuracy", F.lit(accuracy))


def feature_ablation(spark, sf, limit: int = TRAIN_ROWS):
    """A network for all features and one for each at zero, a task each, on one sample; right
    answers are counted over all test rows."""
    rows = _split_rows(spark, sf)
    sample, mean, std = _sample(rows, limit)
    sent = spark.sparkContext.broadcast(sample)  # TRAIN_ROWS rows of sixteen numbers

    def fit(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                x, y, val_x, val_y = (a.copy() for a in sent.value)
                if k >= 0:
                    x[:, k] = val_x[:, k] = 0
                w = M.train(x, y, val_x, val_y, mean, std, epochs=2, batch=256)[0]
                if k >= 0:
                    w.w0[:, k] = 0
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([pickle.dumps(w)])], ["feature", "weights"])

    n = M.INPUTS + 1
    fitted = spark.range(-1, M.INPUTS, 1, n).mapInArrow(fit, "feature long, weights binary").collect()  # a few kB a network
    whole, *without = _accuracy(rows, [pickle.loads(r.weights) for r in sorted(fitted, key=lambda r: r.feature)])
    out = sorted(((k, a, a - whole) for k, a in enumerate(without)), key=lambda r: (r[2], r[0]))
    return spark.createDataFrame(out, "feature int, accuracy double, change double")


def _lists(a: np.ndarray) -> str:
    return "[" + ", ".join("[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in row) + "]" for row in a) + "]"


def _dots(a: np.ndarray, b: np.ndarray, x: str, scale: float = 1.0, relu: bool = True) -> str:
    rows = "[" + ", ".join(f"{{'w': {_lists(r[None])[1:-1]}, 'b': {int(v)}::DOUBLE}}" for r, v in zip(a, b, strict=True)) + "]"
    dot = f"list_inner_product({x}, r.w) * {scale}::DOUBLE + r.b"
    return f"list_transform({rows}, lambda r: {f'greatest(0::DOUBLE, {dot})' if relu else dot})"


def _q(x: str, scale: float) -> str:
    return f"list_transform({x}, lambda v: greatest(-127::DOUBLE, least(127::DOUBLE, round_even(v * {1 / scale}::DOUBLE, 0))))"


_WT = demo_weights()
_BASE = "WITH r AS (SELECT vec_id AS id, label % 3 AS y, list_transform(CAST(embedding[1:16] AS DOUBLE[]), lambda v: round_even(v * 64, 0) / 64) AS f FROM embeddings), n AS (SELECT id, y, list_transform(f, lambda v: v / 2) AS x FROM r)"
_FLOAT = _BASE + f", l1 AS (SELECT id, y, x, {_dots(_WT.w0, _WT.b0, 'x')} AS h1 FROM n), l2 AS (SELECT *, {_dots(_WT.w2, _WT.b2, 'h1')} AS h2 FROM l1), l3 AS (SELECT *, {_dots(_WT.w4, _WT.b4, 'h2', relu=False)} AS lg FROM l2)"
_s = [a * b for a, b in zip(INT8_SCALES, WEIGHT_SCALES, strict=True)]
_INT8 = _BASE + f", i1 AS (SELECT id, {_dots(_WT.w0, _WT.b0, _q('x', INT8_SCALES[0]), _s[0])} AS h1 FROM n), i2 AS (SELECT id, {_dots(_WT.w2, _WT.b2, _q('h1', INT8_SCALES[1]), _s[1])} AS h2 FROM i1), i3 AS (SELECT id, {_dots(_WT.w4, _WT.b4, _q('h2', INT8_SCALES[2]), _s[2], relu=False)} AS lg FROM i2)"
_PRED = "CAST(list_position(lg, list_max(lg)) - 1 AS INTEGER)"


def _hits(name: str, w: M.Weights) -> str:
    return (
        f"SELECT '{name}' AS weights, count(CASE WHEN y = {_PRED} THEN 1 END) AS hits, count(*) AS n FROM (SELECT y, {_dots(w.w4, w.b4, 'h2', relu=False)} AS lg FROM "
        f"(SELECT y, {_dots(w.w2, w.b2, 'h1')} AS h2 FROM (SELECT y, {_dots(w.w0, w.b0, 'x')} AS h1 FROM n)))"
    )


_FLAT = f" SELECT id, lg[1] AS logit_0, lg[2] AS logit_1, lg[3] AS logit_2, {_PRED} AS pred FROM "

CATALOG = {
    "forward_float": (forward_float, _FLOAT + _FLAT + "l3"),
    "forward_int8": (forward_int8, _INT8 + _FLAT + "i3"),
    "argmax_class": (argmax_class, _FLOAT + f" SELECT id, {_PRED} AS pred FROM l3"),
    "checksum": (checksum, _INT8 + " SELECT sum(lg[1]) AS checksum, count(*) AS n FROM i3"),
    "diff_float_int8": (diff_float_int8, _FLOAT + _INT8.replace(_BASE, "") + ", d AS (SELECT l3.id, l3.lg AS a, i3.lg AS b, list_transform(list_zip(l3.lg, i3.lg), lambda p: abs(p[1] - p[2])) AS g FROM l3 JOIN i3 USING (id)) SELECT count(*) AS n, round(max(list_max(g)), 6) AS max_gap, round(sum(list_sum(g)) / sum(len(g)), 6) AS mean_gap, round(max(list_max(g) / greatest(list_max(list_transform(a, lambda v: abs(v))), 1e-12)), 6) AS max_relative, (SELECT id FROM d ORDER BY list_max(g) DESC, id LIMIT 1) AS worst_row, count(CASE WHEN list_position(a, list_max(a)) <> list_position(b, list_max(b)) THEN 1 END) AS class_changes, count(CASE WHEN list_max(g) = 0 THEN 1 END) AS equal_rows FROM d"),
    "model_accuracy": (model_accuracy, _FLOAT + f" SELECT count(CASE WHEN y = {_PRED} THEN 1 END) AS hits, count(*) AS n FROM l3"),
    "quantized_accuracy": (quantized_accuracy, _BASE + " " + " UNION ALL ".join(_hits(n, w) for n, w in (("float", _WT), ("tensor", round_trip(_WT, False)), ("row", round_trip(_WT, True))))),
    "quantize_values": (quantize_values, "SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, CAST(greatest(-127, least(127, round_even(v / 0.03125::DOUBLE, 0))) AS INTEGER) AS q FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings)"),
    "weight_quantize": (weight_quantize, "SELECT vec_id, round(s, 9) AS scale, CAST(list_sum(q) AS BIGINT) AS code_sum, CAST(len(list_filter(q, lambda v: abs(v) = 127)) AS BIGINT) AS at_limit FROM (SELECT vec_id, s, list_transform(t, lambda v: greatest(-127, least(127, round_even(v / s, 0)))) AS q FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS t, list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda v: abs(v))) / 127 AS s FROM embeddings))"),
    "quantize_error": (quantize_error, "SELECT vec_id, round(list_max(list_transform(t, lambda v: abs(v - round_even(v / s, 0) * s))), 9) AS max_error FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS t, list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda v: abs(v))) / 127 AS s FROM embeddings)"),
    "activation_calibration": (activation_calibration, _FLOAT + ", a AS (SELECT 'x' AS point, abs(unnest(x)) AS v FROM l1 UNION ALL SELECT 'h1', unnest(h1) FROM l1 UNION ALL SELECT 'h2', unnest(h2) FROM l2), c AS (SELECT point, max(v) AS largest, quantile_cont(v, 0.9999) AS cutoff FROM a GROUP BY point) SELECT a.point, round(max(largest), 6) AS largest, round(max(cutoff), 6) AS cutoff, round(max(cutoff) / 127, 6) AS scale, round(count(CASE WHEN v > cutoff THEN 1 END) / count(*), 9) AS clipped FROM a JOIN c ON a.point = c.point GROUP BY a.point"),
    "train_mlp": (train_mlp, None),
    "feature_ablation": (feature_ablation, None),
}
