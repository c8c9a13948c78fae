"""Sliding counts of attempts: the login throttle and the contact form's rate limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW_SECONDS, MOST_FAILURES = 900, 5
CONTACT_SECONDS, MOST_CONTACTS = 60, 5


def login_failures(attempts: DataFrame, seconds: int = WINDOW_SECONDS, most: int = MOST_FAILURES) -> DataFrame:
    """Attempts (key, at in epoch seconds, failed) with the failures of the last ``seconds`` (both ends count), and whether the key is locked; a success starts the count anew."""
    order = Window.partitionBy("key").orderBy("at")
    resets = F.coalesce(F.sum((~F.col("failed")).cast("int")).over(order), F.lit(0))
    recent = Window.partitionBy("key", "resets").orderBy("at").rangeBetween(-seconds, 0)
    counted = attempts.withColumn("resets", resets).withColumn("failures", F.count_if("failed").over(recent))
    return counted.withColumn("locked", F.col("failures") >= most).drop("resets")


def contact_hits(hits: DataFrame, seconds: int = CONTACT_SECONDS, most: int = MOST_CONTACTS) -> DataFrame:
    """Hits (key, at) with the hits of the last ``seconds`` (the lower end does not count), and whether they are too many."""
    recent = Window.partitionBy("key").orderBy("at").rangeBetween(-(seconds - 1), 0)
    return hits.withColumn("hits", F.count(F.lit(1)).over(recent)).withColumn("limited", F.col("hits") > most)
