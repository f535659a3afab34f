"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer
network in NumPy whose probabilities are calibrated by a temperature.

Vocabulary and word vectors are statistics of all documents outside the held-out fold, summed
in Spark. Only the small network is fitted on a bounded sample of labelled rows, of which the
driver gets the pooled vectors, not the texts.
"""

from __future__ import annotations

import re
import string
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import discard, held_out, release, staged, table

#: The network is fitted on about this many labelled rows, chosen by hash.
FIT_ROWS = 3000
#: Score from which a document counts as good.
KEEP_FROM = 0.3
#: Units that have a vector: the most frequent ones, each seen more often than LEAST_SEEN.
VOCABULARY = 20_000
LEAST_SEEN = 2
DIMENSIONS = 48
#: Entries of an index vector that are not zero, and units to either side that a word vector adds.
NON_ZERO = 6
WINDOW = 2
HIDDEN = 24
EPOCHS = 60
SEED = 7
#: Bytes of texts whose distinct words are looked up at once, and fewer where each has a vector;
#: results don't depend on them.
CHUNK, POOLED = 8_000_000, 2_000_000
#: Places whose neighbours, and pairs of neighbours whose vectors, are added up at once.
PLACES, PAIRS = 200_000, 16_384
#: The most frequent units, whose neighbours are counted in a table.
FREQUENT = 64

_SIGNS = string.punctuation.replace("_", "")
_PARTS = re.compile(r"\w+|[^\w\s]+")


def units(word: str) -> list[str]:
    """A word's units: each letter run in lower case, each run of signs as it is, and the
    shape of the whole."""
    core = word if word.isalnum() else word.rstrip(_SIGNS)
    if core.isalnum():  # most words: one run, with or without signs behind it
        kind = "=0" if core.isdigit() else "=X" if core.isupper() and len(core) > 1 else "=x"
        signs = word[len(core) :]
        return [core.lower(), "~" + signs[:4], kind + signs[:2]] if signs else [core.lower(), kind]
    out, shape = [], []
    for part in _PARTS.findall(word):
        if part[0].isalnum() or part[0] == "_":
            out.append(part.lower())
            shape.append("0" if part.isdigit() else "X" if part.isupper() and len(part) > 1 else "x")
        else:
            out.append("~" + part[:4])
            shape.append(part[:2])
    out.append("=" + "".join(shape)[:8])
    return out


def index_vector(unit: str) -> np.ndarray:
    """The sparse ternary vector that stands for a unit wherever it is a neighbour."""
    rng = np.random.default_rng(zlib.crc32(unit.encode()))
    v = np.zeros(DIMENSIONS, np.float32)
    v[rng.choice(DIMENSIONS, NON_ZERO, replace=False)] = rng.choice([-1.0, 1.0], NON_ZERO)
    return v


def encoded(texts: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """The texts' words, as many texts at once as have about ``chunk`` bytes: distinct words,
    the places of all words among them, text by text, and the number of words of each text.
    A word costs no Python object but the first time."""
    size, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + chunk, "right")))
        lists = pc.utf8_split_whitespace(pc.fill_null(texts.slice(at, end - at), ""))
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        words = lists.flatten().dictionary_encode()
        codes, names = words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if "" in names:  # white space at the ends of a text parts it from nothing
            some = codes != names.index("")
            counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[some], minlength=len(counts))
            codes = codes[some]
        yield names, codes, counts
        del lists, words, names, codes  # before the next ones are made
        pa.default_memory_pool().release_unused()
        at = end


def unit_ids(words: list[str], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words' units, word by word, -1 for those outside the vocabulary, and the
    number of units of each word."""
    get, flat, sizes = vocabulary.get, [], []
    for word in words:
        own = units(word)
        sizes.append(len(own))
        flat += [get(u, -1) for u in own]
    return np.array(flat, np.int32), np.array(sizes, np.int64)


def met(codes: np.ndarray, counts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts and words that ``encoded`` gives, each pair once."""
    pairs = np.sort(np.repeat(np.arange(len(counts)), counts) * words + codes)
    pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))[: len(pairs)]]
    return pairs // max(words, 1), pairs % max(words, 1)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places ``starts[i]`` to ``starts[i] + sizes[i]`` of each i, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def vocabulary_of(docs: DataFrame, size: int = VOCABULARY) -> dict[str, int]:
    """The ``size`` most frequent units of all texts, each counted once per distinct word of a
    document, by rank. Tasks count their own texts. The driver gets the top and ties with its
    last unit only: a window over the distinct counts says where the top ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            seen: dict[str, int] = {}
            for words, codes, counts in encoded(b.column(0)):
                texts = np.bincount(met(codes, counts, len(words))[1], minlength=len(words))
                for w, n in zip(words, texts.tolist(), strict=True):
                    if n:
                        for u in units(w):
                            seen[u] = seen.get(u, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["unit", "n"])

    counts = docs.select("text").mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    counts = staged(counts.where(F.col("n") > LEAST_SEEN), "units")
    more = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row per distinct count
    least = counts.groupBy("n").agg(F.count("*").alias("units")).withColumn("before", F.coalesce(F.sum("units").over(more), F.lit(0)))
    least = least.where(F.col("before") < size).agg(F.min("n")).first()[0]
    top = counts.where(F.col("n") >= least).collect() if least is not None else []
    discard(counts)
    return {r["unit"]: i for i, r in enumerate(sorted(top, key=lambda r: (-r["n"], r["unit"]))[:size])}


def neighbour_sums(ids: np.ndarray, base: np.ndarray, out: np.ndarray, seen: int = 0) -> None:
    """Add to ``out`` the index vectors of each unit's neighbours up to WINDOW places away;
    negative ids are no units and part texts. Pairs among the first ``seen`` ids, which a part
    before ended in, are not counted again."""
    n, top = len(base), min(FREQUENT, len(base))
    table = np.zeros(top * n)
    for k in range(1, WINDOW + 1):
        skip = max(0, seen - k)
        a, b = ids[skip : len(ids) - k], ids[skip + k :]
        low, high = np.minimum(a, b), np.maximum(a, b)
        pairs = (low.astype(np.int64) * n + high)[low >= 0]
        often = pairs < top * n
        table += np.bincount(pairs[often], minlength=top * n)
        pairs, times = np.unique(pairs[~often], return_counts=True)
        low, high, times = pairs // n, pairs % n, times.astype(np.int32)
        order = np.argsort(high, kind="stable")
        for ones, others, counts in ((low, high, times), (high[order], low[order], times[order])):
            for at in range(0, len(pairs), PAIRS):  # a part of the pairs has its vectors in memory
                part = slice(at, at + PAIRS)
                unit = ones[part]
                first = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
                out[unit[first]] += np.add.reduceat(base[others[part]] * counts[part, None], first, axis=0)
    # whole numbers below 2^53, so products of floats are exact
    table = table.reshape(top, n)
    out[:top] += (table @ base).astype(np.int64)
    out += (table.T @ base[:top]).astype(np.int64)


def word_vectors(docs: DataFrame, vocabulary: dict[str, int]) -> np.ndarray:
    """Random indexing: a unit's vector sums its own index vector and those of its neighbours,
    over all its places in all texts, at length one. Sums are of whole numbers, so no order of
    tasks changes them; a task sends a row per unit that it met, the driver gets the sums."""
    base = np.array([index_vector(u) for u in vocabulary], np.int32).reshape(-1, DIMENSIONS)
    if not len(vocabulary):
        return np.zeros((0, DIMENSIONS), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(vocabulary), DIMENSIONS), np.int64)
        for b in batches:
            for words, codes, counts in encoded(b.column(0)):
                flat, sizes = unit_ids(words, vocabulary)
                # texts are parted by a word of unknown units only
                flat, sizes = np.append(flat, np.full(WINDOW, -1, np.int32)), np.append(sizes, WINDOW)
                codes = np.insert(codes, np.cumsum(counts)[:-1], len(words))
                starts, tail = np.cumsum(sizes) - sizes, flat[:0]
                for at in range(0, len(codes), PLACES):
                    own = codes[at : at + PLACES]
                    ids = np.concatenate((tail, flat[ragged(starts[own], sizes[own])]))
                    neighbour_sums(ids, base, sums, len(tail))
                    tail = ids[-WINDOW:]
        met = np.flatnonzero(sums.any(1)).astype(np.int32)
        for at in range(0, len(met), 2000):
            part = met[at : at + 2000]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * DIMENSIONS), pa.array(sums[part].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(part), lists], ["unit", "v"])

    each = docs.select("text").mapInArrow(run, "unit int, v array<long>")
    found = each.groupBy("unit").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIMENSIONS)]).toArrow()
    out = base.astype(np.float64)
    if found.num_rows:
        out[found.column(0).to_numpy()] += np.column_stack([c.to_numpy() for c in found.columns[1:]])
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)).astype(np.float32)


class Pooler:
    """Texts' mean word vectors, and how much of them is known, repeated and distinct."""

    def __init__(self, vocabulary: dict[str, int], vectors: np.ndarray):
        self.vocabulary, self.vectors = vocabulary, vectors
        # of each unit its vector, whether it is known, and that it is one; the last for unknown units
        self.each = np.zeros((len(vectors) + 1, DIMENSIONS + 2), np.float32)
        self.each[:-1, :DIMENSIONS], self.each[:-1, DIMENSIONS], self.each[:, -1] = vectors, 1, 1

    def word_sums(self, words: list[str]) -> np.ndarray:
        """For each word the sum of its units' rows of ``each``."""
        ids, sizes = unit_ids(words, self.vocabulary)
        starts, left, k = np.cumsum(sizes) - sizes, np.flatnonzero(sizes > 2), 2
        out = self.each[ids[starts]]
        out += self.each[ids[np.minimum(starts + 1, len(ids) - 1)]]  # all but the empty word, which no text has, have two
        while len(left):
            out[left] += self.each[ids[starts[left] + k]]
            k += 1
            left = left[sizes[left] > k]
        return out

    def pool(self, texts: pa.Array | list[str | None]) -> np.ndarray:
        """(texts, DIMENSIONS + 4). A text without words is all zeros."""
        out, row = np.zeros((len(texts), DIMENSIONS + 4)), 0
        for words, codes, counts in encoded(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts, POOLED):
            sums, end = self.word_sums(words), 0
            distinct = np.bincount(met(codes, counts, len(words))[0], minlength=len(counts))
            for n, kinds in zip(counts.tolist(), distinct.tolist(), strict=True):
                own = codes[end : end + n]
                if n:
                    total = np.zeros(DIMENSIONS + 2)
                    for part in range(0, n, 50_000):
                        values = sums[own[part : part + 50_000]]
                        total += np.ones(len(values), np.float32) @ values
                    out[row, : DIMENSIONS + 1] = total[:-1] / total[-1]
                    out[row, -3:] = np.count_nonzero(own[1:] == own[:-1]) / n, kinds / n, np.log1p(n) / 10
                end, row = end + n, row + 1
        return out


class Network:
    """Inputs standardised; a hidden layer of rectified units; one logistic output whose logit
    is divided by the calibrated temperature."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        rng = np.random.default_rng(SEED)
        self.mean, self.std = x.mean(0), np.maximum(x.std(0), 1e-4)
        x = (x - self.mean) / self.std
        side = rng.random(len(x)) < 0.2  # to choose the epoch and the temperature
        if side.all() or not side.any():
            side = np.arange(len(x)) % 5 == 0
        fit_x, fit_y = x[~side], y[~side]
        p = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1)]
        m, v, step, best = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0, None
        for _ in range(EPOCHS):
            order = rng.permutation(len(fit_x))
            for at in range(0, len(order), 64):
                bx, by = fit_x[order[at : at + 64]], fit_y[order[at : at + 64]]
                h = np.maximum(bx @ p[0] + p[1], 0)
                g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - by) / len(bx)
                gh = np.outer(g, p[2]) * (h > 0)
                grads = [bx.T @ gh + 1e-4 * p[0], gh.sum(0), h.T @ g + 1e-4 * p[2], np.array([g.sum()])]
                step += 1
                for i, d in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * d
                    v[i] = 0.999 * v[i] + 0.001 * d * d
                    p[i] = p[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
            self.p, self.temperature = p, 1.0
            loss = self._loss(x[side], y[side])
            if best is None or loss < best[0]:
                best = (loss, [a.copy() for a in p])
        self.p = best[1]
        steps = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        losses = []
        for self.temperature in steps:
            losses.append(self._loss(x[side], y[side]))
        self.temperature = float(steps[int(np.argmin(losses))])
        return self

    def _logits(self, z: np.ndarray) -> np.ndarray:
        return (np.maximum(z @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]) / self.temperature

    def _loss(self, z: np.ndarray, y: np.ndarray) -> float:
        t = self._logits(z)
        return float(np.mean(np.logaddexp(0, t) - y * t))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logits((x - self.mean) / self.std), -30, 30)))


class Classifier:
    """What is sent to the executors: a vocabulary, its vectors and a small network, all of
    fixed size. Without both labels to learn from there is no network, and every score is the
    labels' mean, or 1 without any."""

    def __init__(self, pooler: Pooler, x: np.ndarray, y: np.ndarray):
        self.pooler, self.network, self.constant = pooler, None, None
        if len(set(y.tolist())) > 1:
            self.network = Network().fit(x, y)
        else:
            self.constant = float(y.mean()) if len(y) else 1.0
            warnings.warn(f"no two labels to learn quality from: every document scores {self.constant}", stacklevel=3)

    def score(self, texts: pa.Array | list[str | None]) -> np.ndarray:
        if self.network is None or not len(texts):
            return np.full(len(texts), 0.0 if self.constant is None else self.constant)
        return self.network.probability(self.pooler.pool(texts))


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Classifier:
    """Word vectors from all documents outside the held-out fold; the network from about
    ``fit_rows`` labelled ones of them, whatever their length, chosen by the hash of doc_id.
    Texts stay on the executors. Null labels and labels without a document are ignored. An id
    of several labels has that of most of its rows (good, if even). Where ids repeat in ``docs``,
    the rows with the smallest hashes of id and text are learned from, so reruns agree."""
    open_docs = docs.where(~held_out(F.col("doc_id")))
    vocabulary = vocabulary_of(open_docs)
    pooler = Pooler(vocabulary, word_vectors(open_docs, vocabulary))
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_id"))
    known = known.agg((F.avg((F.col("quality") > 0).cast("int")) >= 0.5).cast("int").alias("quality"))
    total = known.count()
    share = min(1.0, fit_rows / total) if total else 0.0
    chosen = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < share * 1_000_000).orderBy(F.xxhash64("_id"), "_id").limit(2 * fit_rows)

    @F.arrow_udf("array<float>")
    def pooled(texts: pa.Array) -> pa.Array:
        x = pooler.pool(texts).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    # broadcast: at most 2 x fit_rows ids
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = rows.select("doc_id", "quality", pooled("text").alias("x"), F.xxhash64("doc_id", "text").alias("_order"))
    rows = rows.orderBy("_order", "doc_id").limit(2 * fit_rows).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"], r["quality"]))
    x = np.array([r["x"] for r in rows], np.float64).reshape(-1, DIMENSIONS + 4)
    return Classifier(pooler, x, np.array([r["quality"] > 0 for r in rows], np.float64))


def score_of(model: Classifier, text: str = "text") -> Column:
    """Score of a text column: whole texts, no shuffle."""
    shared = model

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.score(texts))

    return score(F.col(text))


def score_documents(docs: DataFrame, model: Classifier, keep_from: float = KEEP_FROM) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row.

    Null texts, empty ones and white space pool to a vector of zeros and get its score.
    Repeated rows give repeated results, and an empty table an empty one. Nothing but the
    text enters a score.
    """
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_of(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= keep_from).cast("int"))


def keep_good(docs: DataFrame, model: Classifier, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows, all columns as they are, that score ``keep_from`` or more; null and empty
    texts have a score, too. Repeated rows stay or go together."""
    return docs.where(score_of(model) >= keep_from)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
