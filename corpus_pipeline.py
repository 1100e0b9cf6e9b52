"""A training-corpus pipeline: each stage takes the documents its predecessor kept and returns what it keeps.

Stages are written as Parquet and read again, so a later stage never repeats an earlier one's work and a lost executor
costs its running tasks only. All stages but the last return the columns of documents; the last adds shard and slot.

Odd input is each operator's: null, empty and word-less texts are judged by the quality classifier's bias alone, and of those
it keeps one stays; rows that repeat or share an id are told apart by a written row number; columns beside those of documents
pass through under any name; empty tables give empty tables; very long texts are taken whole in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempora.llm import decontam, mixing, quality, sharding, shingles
from tempora.llm.common import discard, durable, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays: SimHash proposes, a similarity of 0.8 on five-word shingles decides."""
    return shingles.keep_one(docs, similarity=0.8, width=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs go."""
    return decontam.keep_clean(docs, read(spark, sf_dir, "benchmark"), least_items=1)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("hilbert sharding", sharding_stage),
]

#: The classifier has no SQL form; tests hold each stage against a plain version on that stage's own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            kept = durable(kept, f"stage{i}")
            discard(docs)  # what the stage before wrote; the input is not ours
        docs = kept
    return docs
