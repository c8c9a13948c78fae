"""Corpus pipeline: quality, exact and near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``; all but the last return the
columns of ``documents``.

Defined cases, in every stage: null text counts as empty text, and texts of any
length are taken whole; rows without shingles (empty or blank texts) have no near
duplicates; a null id stays only where its group has no other, a null source is a
source of its own; of rows that tie on id and text one stays in the duplicate stages;
an empty table gives an empty result; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm import exact_dedup, minhash, mixing, packing, quality, tokens
from auditloom.llm.queries import prepare
from auditloom.llm.runtime import materialize, table

#: Near duplicates share so many percent of their shingles (op2's own percent is another).
NEAR_PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on the labelled ones among them."""
    prepare(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts: that with the largest id."""
    prepare(spark)
    return exact_dedup.keep_one(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id."""
    prepare(spark)
    return minhash.keep_one(docs, NEAR_PERCENT)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: each up to three times, or not at all."""
    prepare(spark)
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of at most 1024 tokens."""
    prepare(spark)
    return packing.packing(docs, tokenizer=tokens.default_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
    return docs
