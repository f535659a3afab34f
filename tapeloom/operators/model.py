"""The small network: scoring in float32 and int8, quantisation, calibration, training.

Rows are scored in Arrow batches by matrix products over the batch; weights are a few
thousand numbers and travel with the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.dataset import linear_percentiles

INPUTS, HIDDEN, CLASSES = 16, 32, 3


@dataclass
class Weights:
    """Float weights, (out, in) each, and the normalisation of the inputs."""

    mean: np.ndarray
    std: np.ndarray
    w0: np.ndarray
    b0: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    w4: np.ndarray
    b4: np.ndarray

    def __post_init__(self):
        for name, shape in (("mean", (INPUTS,)), ("std", (INPUTS,)), ("w0", (HIDDEN, INPUTS)), ("b0", (HIDDEN,)), ("w2", (HIDDEN, HIDDEN)), ("b2", (HIDDEN,)), ("w4", (CLASSES, HIDDEN)), ("b4", (CLASSES,))):
            value = np.asarray(getattr(self, name), np.float32)
            if value.shape != shape:
                raise ValueError(f"{name} has shape {value.shape}, not {shape}")
            setattr(self, name, value)

    @staticmethod
    def layer(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sums that start at the bias and take one input after the other, each in a float32 step
        of its own, for all rows at once: the same bits whatever the size of the batch."""
        out = np.repeat(b[None], len(x), axis=0)
        for i in range(x.shape[1]):
            out += x[:, i, None] * w[:, i]
        return out

    def hidden(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised inputs and both hidden layers."""
        x = (f.astype(np.float32) - self.mean) / self.std
        h1 = np.maximum(self.layer(x, self.w0, self.b0), np.float32(0))
        return x, h1, np.maximum(self.layer(h1, self.w2, self.b2), np.float32(0))

    def forward(self, f: np.ndarray) -> np.ndarray:
        return self.layer(self.hidden(f)[2], self.w4, self.b4)


def quantize_array(v: np.ndarray, inverse_scale: np.float32) -> np.ndarray:
    """Round half to even, held to -127..127; NaN and what is 2**63 or more become -127."""
    with np.errstate(all="ignore"):
        r = v.astype(np.float32) * np.float32(inverse_scale)
        big = np.isnan(r) | (r >= np.float32(2**63))
        return np.where(big, -127, np.clip(np.rint(np.where(big, 0, r)), -127, 127)).astype(np.int32)


@dataclass(frozen=True)
class Codes:
    """A tensor in steps: whole numbers from -127 to 127, and the size of a step, one for the
    whole tensor or, along ``axis``, one for each of its rows."""

    steps: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, tensor: np.ndarray, axis: int | None = None) -> Codes:
        reach = np.max(np.abs(tensor), axis=axis, keepdims=True)
        size = np.where(reach > 0, reach / 127, 1.0)
        return cls(np.rint(tensor / size).clip(-127, 127).astype(np.int8), size.astype(np.float32))

    def restored(self) -> np.ndarray:
        return self.size * self.steps.astype(np.float32)

    def report(self, tensor: np.ndarray) -> dict[str, float]:
        """How far the codes are from the tensor that they stand for."""
        off = np.subtract(tensor, self.restored(), dtype=np.float64)
        return {"largest": float(np.abs(off).max()), "relative": float(np.sqrt((off**2).sum() / (np.asarray(tensor, np.float64) ** 2).sum()))}


@dataclass
class Int8Weights:
    """Quantised weights with one scale a tensor, float biases, and the scales of the three
    activations that are quantised."""

    mean: np.ndarray
    std: np.ndarray
    scales: np.ndarray
    weight_scales: np.ndarray
    w0: np.ndarray
    b0: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    w4: np.ndarray
    b4: np.ndarray

    @classmethod
    def of(cls, w: Weights, scales) -> Int8Weights:
        layers = [Codes.of(t) for t in (w.w0, w.w2, w.w4)]
        sizes = np.concatenate([c.size.ravel() for c in layers])
        return cls(w.mean, w.std, np.float32(scales), sizes, layers[0].steps, w.b0, layers[1].steps, w.b2, layers[2].steps, w.b4)

    def forward(self, f: np.ndarray) -> np.ndarray:
        """Whole-number dot products; each layer scaled, biased and quantised again, in
        separate float32 steps."""
        one = np.float32(1)
        x = (f.astype(np.float32) - self.mean) * (one / self.std)
        for i, (w, b) in enumerate(((self.w0, self.b0), (self.w2, self.b2), (self.w4, self.b4))):
            q = quantize_array(x, one / self.scales[i])
            x = (q @ w.T.astype(np.int32)).astype(np.float32) * (self.scales[i] * self.weight_scales[i]) + b
            if i < 2:
                x = np.maximum(x, np.float32(0))
        return x


#: Scoring backends by name: the weights that each takes, and its function of a batch.
BACKENDS: dict[str, tuple[type, Callable]] = {"float": (Weights, Weights.forward), "int8": (Int8Weights, Int8Weights.forward)}


def backend_of(name: str, weights) -> Callable[[np.ndarray], np.ndarray]:
    if name not in BACKENDS:
        raise ValueError(f"no backend {name!r}; there are {', '.join(BACKENDS)}")
    kind, forward = BACKENDS[name]
    if not isinstance(weights, kind):
        raise TypeError(f"backend {name} scores with {kind.__name__}, not {type(weights).__name__}")
    return lambda f: forward(weights, f)


def score(rows: DataFrame, weights, key: str = "id", features: str = "f", backend: str = "float") -> DataFrame:
    """``key, logits, pred`` of every row: no shuffle, one matrix product a layer and batch."""
    forward = backend_of(backend, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            logits = forward(f).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * CLASSES), pa.array(logits.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(logits.argmax(1).astype(np.int32))], [key, "logits", "pred"])

    return rows.select(F.col(key).cast("long"), F.col(features).cast("array<float>")).mapInArrow(run, f"{key} long, logits array<float>, pred int")


def activations(rows: DataFrame, weights: Weights, features: str = "f") -> DataFrame:
    """``x, h1, h2`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array(list(a), pa.list_(pa.float32())) for a in weights.hidden(f)], ["x", "h1", "h2"])

    return rows.select(F.col(features).cast("array<float>")).mapInArrow(run, "x array<float>, h1 array<float>, h2 array<float>")


def calibration(acts: DataFrame, p: float = 0.9999) -> DataFrame:
    """Per activation: its largest magnitude, the percentile at which it is cut, the scale
    that gives, and the share of values beyond."""
    both = F.array(*[F.struct(F.lit(n).alias("point"), F.col(n).alias("v")) for n in ("x", "h1", "h2")])
    each = acts.select(F.explode(both).alias("a")).select("a.point", F.explode("a.v").alias("v"))
    each = each.select("point", F.abs(F.col("v").cast("double")).alias("v"))
    cut = linear_percentiles(each, "v", {"cutoff": p, "largest": 1.0}, ["point"])
    over = each.join(F.broadcast(cut), "point")  # three rows
    out = over.groupBy("point").agg(F.first("largest").alias("largest"), F.first("cutoff").alias("cutoff"), (F.count_if(F.col("v") > F.col("cutoff")) / F.count("*")).alias("clipped"))
    return out.withColumn("scale", F.col("cutoff") / 127)


def train(x: np.ndarray, y: np.ndarray, val_x: np.ndarray, val_y: np.ndarray, mean=None, std=None, epochs: int = 8, batch: int = 4096, rate: float = 1e-3, seed: int = 0) -> tuple[Weights, float]:
    """Cross-entropy training with Adam on normalised inputs; the weights of the first epoch
    with the best validation accuracy. The rows are a bounded sample that the caller collects."""
    rng = np.random.default_rng(seed)
    p = []
    for out, inp in ((HIDDEN, INPUTS), (HIDDEN, HIDDEN), (CLASSES, HIDDEN)):
        bound = 1 / np.sqrt(inp)
        p += [rng.uniform(-bound, bound, (out, inp)), rng.uniform(-bound, bound, out)]
    m, v, step, best = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0, (-1.0, None)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            bx, by = x[order[at : at + batch]], y[order[at : at + batch]]
            h1 = np.maximum(bx @ p[0].T + p[1], 0)
            h2 = np.maximum(h1 @ p[2].T + p[3], 0)
            z = h2 @ p[4].T + p[5]
            e = np.exp(z - z.max(1, keepdims=True))
            g = e / e.sum(1, keepdims=True)
            g[np.arange(len(by)), by] -= 1
            g /= len(by)
            g2 = (g @ p[4]) * (h2 > 0)
            g1 = (g2 @ p[2]) * (h1 > 0)
            step += 1
            for i, d in enumerate((g1.T @ bx, g1.sum(0), g2.T @ h1, g2.sum(0), g.T @ h2, g.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        z = np.maximum(np.maximum(val_x @ p[0].T + p[1], 0) @ p[2].T + p[3], 0) @ p[4].T + p[5]
        accuracy = float((z.argmax(1) == val_y).mean()) if len(val_y) else 0.0
        if accuracy > best[0]:
            best = (accuracy, [a.copy() for a in p])
    zeros, ones = np.zeros(INPUTS), np.ones(INPUTS)
    w = Weights(zeros if mean is None else mean, ones if std is None else std, *best[1])
    return w, best[0]

