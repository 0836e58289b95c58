"""A corpus pipeline of the operators in graphwarden.llm.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps; what it returns is
written as Parquet and read again as the next stage's input. All but the last return the columns of
``documents``; the last adds the ids of each text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphwarden.llm import bpe, decontam, jaccard, sufdedup, toxicity
from graphwarden.llm.storage import clear, materialize, table, written


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (Jaccard >= 0.8 over five words) the least id stays."""
    return jaccard.keep_one(docs)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that start elsewhere too are cut out."""
    return sufdedup.deduplicate(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of test items are cut out; documents made of them by half go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with ids (packed little-endian unsigned 32-bit integers) and n_tokens."""
    return bpe.encode(docs, bpe.vocabulary())


STAGES = [
    ("toxicity", toxic_out),
    ("ngram_jaccard_join", near_duplicates_out),
    ("suffix_array_dedup", repeats_out),
    ("benchmark_decontamination", benchmark_out),
    ("bpe_encoding", encoded),
]

#: No SQL: a trained classifier, components and BPE ids can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows after the last stage; what the stages wrote besides is deleted."""
    docs, mark = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        clear(spark, mark, but=docs)
    return docs
