"""Texts about checks: a dimension joined to findings, with fallbacks for unknown checks and missing translations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import humanize
from ..operators.checks import REGISTRY

TEXTS = "rule_id string, title string, family string, description string"


def english(spark) -> DataFrame:
    """The registry's own texts."""
    rows = [(c.id, None, c.id.split(".")[0], c.description) for c in REGISTRY.values()]
    base = spark.createDataFrame(rows, TEXTS)
    return base.withColumn("title", humanize(F.regexp_replace("rule_id", r"\.", " ")))


def translated(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Base texts with those of an overlay wherever it has them."""
    over = overlay.select("rule_id", *[F.col(c).alias(f"__{c}") for c in ("title", "family", "description")])
    return base.join(over, "rule_id", "left").select("rule_id", *[F.coalesce(f"__{c}", c).alias(c) for c in ("title", "family", "description")])


def described(findings: DataFrame, texts: DataFrame) -> DataFrame:
    """Findings with their texts; unknown checks get a title made from their id and the family Other."""
    known = findings.join(texts, "rule_id", "left")
    title = F.coalesce("title", humanize(F.regexp_replace("rule_id", r"[.]", " ")))
    return known.withColumns({"title": title, "family": F.coalesce("family", F.lit("Other")), "description": F.coalesce("description", F.lit("See the details of the pages listed."))})
