"""Sampling of pages for performance runs, and what becomes of the results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import template_key

STRATEGIES = ("mobile", "desktop")
MOST_SAMPLES = 20


def candidates(pages: DataFrame) -> DataFrame:
    """Live HTML pages: url, inlink_count, depth."""
    return pages.where((F.col("status_class") == "2xx") & F.lower("content_type").startswith("text/html")).select("url", "inlink_count", "depth")


def representatives(found: DataFrame) -> DataFrame:
    """template_key, url, cluster_size: of each template the page with most inlinks, then least depth, then first by name."""
    keyed = found.withColumn("template_key", template_key(F.col("url")))
    best = F.struct((-F.col("inlink_count")).alias("i"), F.col("depth").alias("d"), F.col("url").alias("url"))
    return keyed.groupBy("template_key").agg(F.min(best)["url"].alias("url"), F.count(F.lit(1)).alias("cluster_size"))


def samples(found: DataFrame, most: int = MOST_SAMPLES) -> DataFrame:
    """The representatives of the largest templates."""
    return representatives(found).orderBy(F.desc("cluster_size"), "template_key").limit(most)


def pairs(sampled: DataFrame) -> DataFrame:
    """url, strategy: every sample under every strategy."""
    return sampled.select("url", F.explode(F.array(*map(F.lit, STRATEGIES))).alias("strategy"))


def uncached(wanted: DataFrame, performance: DataFrame) -> DataFrame:
    """The pairs that have no row yet."""
    return wanted.join(performance.select(F.col("page_url").alias("url"), "strategy"), ["url", "strategy"], "left_anti")


def upsert(performance: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row per audit, page and strategy; fresh ones replace old ones."""
    place = F.row_number().over(Window.partitionBy("audit_id", "page_url", "strategy").orderBy(F.desc("__new")))
    both = performance.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
    return both.withColumn("__place", place).where("__place = 1").drop("__place", "__new")


def outcome(runs: DataFrame, wanted: DataFrame, performance: DataFrame) -> DataFrame:
    """requested, cached, ok and failed pairs of a run (runs: url, strategy, error)."""
    all_pairs = wanted.join(performance.select(F.col("page_url").alias("url"), "strategy", F.lit(True).alias("c")).distinct(), ["url", "strategy"], "left").agg(F.count(F.lit(1)).alias("requested"), F.count("c").alias("cached"))
    return all_pairs.crossJoin(runs.agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count("error").alias("failed")))  # one row each


def refresh(findings: DataFrame, perf_findings: DataFrame) -> DataFrame:
    """Findings with those of the performance checks replaced."""
    return findings.where(~F.col("rule_id").startswith("perf.")).unionByName(perf_findings)
