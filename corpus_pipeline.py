"""The corpus pipeline: language ID, exact dedup, near-dedup, benchmark decontamination, packing.

Each stage is a function of (spark, docs, sf_dir) that works on all its predecessor kept. All but the last return the columns of ``documents``.

Defined results: null and empty texts have no language and go in the first stage (given to a later one, null is empty text); decisions are made row by row, so
rows that repeat an id with other texts are judged each; ties go to the smallest id, null ids last; texts are read whole, however long; an empty table gives an
empty result; extra columns stay until packing, which ignores them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm import decontamination, exact_dedup, language_id, near_copies, packing
from loamgraph.llm.queries import SEQUENCE_TOKENS, remainder
from loamgraph.session import discard, scratch, table

#: A text that no learned language explains better than the others by any margin has a score of 1 / languages; letters of unknown scripts too.
LEAST_LANGUAGE_SCORE = 0.3

#: Near copies: SimHash fingerprints find them; a link needs this Jaccard similarity of the texts' sets of five-word shingles.
NEAR, SHINGLE_WORDS = 0.8, 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without letters, or that fit no language, go."""
    model = language_id.fit(docs, learn_from=remainder(4) != 2)
    return language_id.keep_identified(docs, model, LEAST_LANGUAGE_SCORE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row: that with the smallest id, null ids last; rows that repeat an id and a text are one document."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, one row: that with the smallest id, null ids last; rows that repeat an id and a text are one document."""
    return near_copies.keep_one(docs, least=NEAR, width=SHINGLE_WORDS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    return packing.best_fit(docs, SEQUENCE_TOKENS)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]

#: SQL can express neither the language model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is written to the shared folder and read again, and goes when its successor's is written."""
    docs, folder, before = table(spark, sf_dir, "documents"), scratch(spark, "pipeline"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            discard(spark, before)
        before = path
    return docs
