"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns
the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm import language, mixing, packing, quality, shingle_sets
from tapeloom.llm.common import discard, staged, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language go on; null texts and texts without letters go. Null ids and
    repeated rows are rows like any other."""
    return language.keep_identified(docs, language.learn_profiles(docs))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as good go on. Every row is scored by its text alone: null and empty
    texts by the score of no words, repeated rows alike, null ids like any other. Without two
    labels to learn from all go on, with a warning."""
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, an exact similarity of 0.8 or more)
    the document with the smallest doc_id stays, one with a null doc_id only for a group of
    nothing else. Rows that are equal throughout are one; texts without words are equal."""
    return shingle_sets.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each row as the mix takes, in training order. A null source is a source
    of its own; repeated rows and null ids are rows of their own; texts without words go."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their places in sequences. Each row is a document, repeated
    ones and null ids too; a null text is packed as an empty one, by its end id."""
    return packing.pack_documents(docs, packing.default_tokenizer(), packing.CAPACITY, keep_ids=False)


STAGES = [
    ("language", identify_language),
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Several stages are models or tokenizers, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = staged(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
