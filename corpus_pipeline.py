"""Corpus pipeline: toxicity, exact dedup, near-duplicate dedup and packing, each stage on what the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All stages but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.common import materialise
from ledgerloom.llm.exact_dedup import drop_exact_copies
from ledgerloom.llm.ngram_join import keep_one_of_each_component
from ledgerloom.llm.packing import pack_documents, pieces_digest
from ledgerloom.llm.toxicity import drop_toxic, learn_lexicon


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the lexicon learned from the labels scores 0.5 or more."""
    return drop_toxic(docs, learn_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, keeps the longest, then the one with the smallest id."""
    return drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group joined by near-duplicate links: five words, Jaccard 0.8."""
    return keep_one_of_each_component(docs, size=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens, in the order of the Hilbert curve."""
    return pieces_digest(pack_documents(docs))


STAGES = [("toxicity", without_toxic), ("exact_dedup", without_copies), ("ngram_jaccard_join", without_near_copies), ("packing", packed)]

#: The lexicon, the curve and the tokenizer have no SQL form; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
