"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..ship import ship
from . import ann, exact_dedup, fill_middle, html_blocks, licenses, minhash, mixing, packing, prefix_trie, quality, token_counts, tokens, toxicity, warc
from .runtime import table

#: Rows of one Arrow batch; texts may be long, so fewer than Spark's own 10,000.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Session settings that the operators count on."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def _over(name: str, run: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return run(table(spark, sf_dir, name))

    return query


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": _over("documents", licenses.license_scan),
        "op2_minhash_near_dedup": _over("documents", minhash.near_duplicates),
        "op3_warc": _over("pages", warc.warc),
        "op4_exact_dedup": _over("documents", exact_dedup.exact_dedup),
        "op5_html_extraction": _over("pages", html_blocks.extract),
        "op6_packing": _over("documents", lambda docs: packing.packing(docs, tokenizer=tokens.default_path())),
        "op7_quality_classifier": quality_classifier,
        "op8_token_counts": _over("documents", lambda docs: token_counts.token_counts(docs, tokenizer=tokens.default_path())),
        "op9_source_mixing": _over("documents", mixing.source_mixing),
        "op10_nearest_neighbours": _over("embeddings", ann.nearest_neighbours),
        "op11_fill_in_middle": _over("documents", fill_middle.fill_in_middle),
        "op12_prefix_trie": _over("conversations", prefix_trie.prefix_trie),
        "op13_toxicity": toxic,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": warc.ORACLE_SQL,
        "op4_exact_dedup": exact_dedup.ORACLE_SQL,
        "op9_source_mixing": mixing.ORACLE_SQL,
        "op11_fill_in_middle": fill_middle.ORACLE_SQL,
        "op12_prefix_trie": prefix_trie.ORACLE_SQL,
    }
