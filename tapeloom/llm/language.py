"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import held_out, release, table

#: n-grams to a profile, and documents of each language that its profile is learned from:
#: about this many, chosen by hash, whatever the size of the corpus.
PROFILE = 400
LEARN_FROM = 1500
#: More language names than this are an error in the labels: profiles of all are sent to every
#: worker, and each document is compared with all.
MAX_LANGUAGES = 5_000
#: Documents whose best profile is nearer than this share of the largest distance are kept.
KEEP_FROM = 0.05
#: Characters counted at a time, up to the next white space.
_BLOCK = 1 << 20
_SPACE = re.compile(r"\s")


@lru_cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _blocks(text: str) -> Iterator[str]:
    """Parts of a text that end at white space, so that no word and no letter case depends on
    where it is parted."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + _BLOCK)
        end = space.end() if space else len(text)
        yield text[at:end]
        at = end


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, count) of one to three characters of the lower-cased text, words padded with a
    space; anything but letters parts words. An n-gram is its code points in 21 bits each."""
    found = []
    for part in _blocks(text):
        c = np.frombuffer(part.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = _letters()[c]
        c = np.where(word, c, 32)
        keep = word.copy()
        keep[1:] |= word[:-1]
        c = np.concatenate(([32], c[keep], [32]))
        w = c != 32
        two = (c[:-1] << 21) | c[1:]
        three = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
        found.append(np.unique(np.concatenate((c[w], two[w[:-1] | w[1:]], three[w[1:-1]])), return_counts=True))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(found) == 1:
        return found[0]
    grams, index = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    return grams, np.bincount(index, weights=np.concatenate([n for _, n in found])).astype(np.int64)


def ranked(text: str, k: int) -> np.ndarray:
    """The ``k`` most frequent n-grams, most frequent first, equals by code points."""
    grams, n = ngrams(text)
    if len(grams) > 4 * k:
        least = np.partition(n, len(n) - k)[len(n) - k]
        grams, n = grams[n >= least], n[n >= least]
    return grams[np.lexsort((grams, -n))[:k]]


class Profiles:
    """Each language's n-grams by rank."""

    def __init__(self, ranks: dict[str, list[int]], k: int = PROFILE):
        self.k = k
        self.langs = sorted(ranks)
        self.tables = []
        for lang in self.langs:
            grams = np.array(ranks[lang], np.int64)
            order = np.argsort(grams)
            self.tables.append((grams[order], order))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, 1 - distance / largest distance); ``und``, 0 without letters."""
        own = ranked(text, self.k) if text else ()
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.arange(len(own))
        best = (-1, "und")
        for lang, (grams, rank) in zip(self.langs, self.tables, strict=True):
            i = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            distance = int(np.where(grams[i] == own, np.abs(rank[i] - at), self.k).sum())
            if best[0] < 0 or distance < best[0]:
                best = (distance, lang)
        return best[1], 1.0 - min(1.0, best[0] / (len(own) * self.k))


def learn_profiles(docs: DataFrame, k: int = PROFILE, learn_from: int = LEARN_FROM, max_languages: int = MAX_LANGUAGES) -> Profiles:
    """Profiles from ``text`` and non-null ``lang`` of documents outside the held-out fold.

    A first pass counts languages (no text is read); about ``learn_from`` documents of each,
    chosen by the hash of doc_id, give the n-grams, which are summed in Spark. The driver gets
    ``k`` ranks of each language; more than ``max_languages`` are refused.
    """
    known = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(max_languages + 1).collect()
    if not counts:
        return Profiles({}, k)
    if len(counts) > max_languages:
        raise ValueError(f"documents name more than {max_languages} languages; pass a higher max_languages if they do mean that")
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, learn_from / r["count"])))])
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.try_element_at(share, F.col("lang")) * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sums: dict[str, dict[int, int]] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = sums.setdefault(lang, {})
                for g, n in zip(*(x.tolist() for x in ngrams(text or "")), strict=True):
                    own[g] = own.get(g, 0) + n
        for lang, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], ["lang", "gram", "n"])

    grams = known.where(chosen).select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    grams = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    ranks: dict[str, list[int]] = {}
    for r in grams.withColumn("rank", top).where(F.col("rank") <= k).orderBy("lang", "rank").collect():
        ranks.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranks, k)


def language_of(profiles: Profiles, text: str = "text") -> Column:
    """struct(lang_pred, score) of a text column: whole texts, no shuffle."""
    shared = profiles

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict(F.col(text))


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row.

    Null texts and texts without letters are ``und`` with score 0, as is everything if no
    language was learned. Languages at equal distance go by name. Repeated rows give repeated
    results, and an empty table an empty result. Nothing but the text enters a prediction.
    """
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language_of(profiles).alias("_p")).select("doc_id", "held_out", "_p.lang_pred", "_p.score")


def keep_identified(docs: DataFrame, profiles: Profiles, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows, all columns as they are, whose text has a language: not ``und``, and nearer
    to its profile than ``keep_from`` asks. Null texts and texts without letters go; repeated
    rows stay or go together."""

    @F.pandas_udf("boolean")
    def identified(texts: pd.Series) -> pd.Series:
        found = (profiles.predict(t) for t in texts)
        return pd.Series([lang != "und" and score >= keep_from for lang, score in found], dtype=bool)

    return docs.where(identified(F.col("text")))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn_profiles(docs))
