"""Metrics and flags from PageSpeed JSON, by expressions over a declared schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import PSI

#: A reply that says why it has no results, and the place for a body that cannot be read.
_REPLY = T.StructType([*PSI.fields, T.StructField("error", T.StructType().add("code", T.DoubleType()).add("message", T.StringType())), T.StructField("_unread", T.StringType())])
CAUSES = ("no body", "malformed", "error reply", "no results")

#: Scores below these make a flag, by category.
FLAG_BELOW = {"performance": 0.9, "seo": 1.0}


def _flags(psi: Column, category: str) -> Column:
    ids = F.transform(psi["lighthouseResult"]["categories"][category]["auditRefs"], lambda r: r["id"])
    audits = psi["lighthouseResult"]["audits"]
    return F.coalesce(F.filter(ids, lambda i: F.coalesce(F.try_element_at(audits, i)["score"] < FLAG_BELOW[category], F.lit(False))), F.array().cast("array<string>"))


def parse(rows: DataFrame, column: str = "psi_raw") -> DataFrame:
    """``rows`` with the metrics of their JSON; parts that are absent give nulls and fewer flags."""
    psi = F.col("__psi")
    field = lambda name: F.try_element_at(psi["loadingExperience"]["metrics"], F.lit(name))["percentile"]
    audit = lambda name: F.try_element_at(psi["lighthouseResult"]["audits"], F.lit(name))["numericValue"]
    whole = lambda x: F.round(x).cast("int")
    score = F.try_element_at(psi["lighthouseResult"]["categories"], F.lit("performance"))["score"]
    return (
        rows.withColumn("__psi", F.from_json(column, PSI))
        .withColumns({
            "lcp_ms": whole(F.coalesce(field("LARGEST_CONTENTFUL_PAINT_MS"), audit("largest-contentful-paint"))),
            "cls": F.round(F.coalesce(field("CUMULATIVE_LAYOUT_SHIFT_SCORE") / 100, audit("cumulative-layout-shift")), 3).cast("float"),
            "inp_ms": whole(field("INTERACTION_TO_NEXT_PAINT")),
            "performance_score": F.round(score * 100).cast("float"),
            "fcp_ms": whole(audit("first-contentful-paint")),
            "tbt_ms": whole(audit("total-blocking-time")),
            "speed_index_ms": whole(audit("speed-index")),
            "usability_flags": F.array_sort(F.array_union(_flags(psi, "performance"), _flags(psi, "seo"))),
        })
        .drop("__psi")
    )


def cause(column: str = "psi_raw") -> Column:
    """Why a body is no result (null if it is one): there is none, it is no JSON of the expected types, it reports an error, or it has neither field nor lab data."""
    reply = F.from_json(column, _REPLY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unread"})
    return (
        F.when(F.coalesce(F.trim(F.col(column)), F.lit("")) == "", CAUSES[0])
        .when(reply.isNull() | reply["_unread"].isNotNull(), CAUSES[1])
        .when(reply["error"].isNotNull(), CAUSES[2])
        .when(reply["loadingExperience"].isNull() & reply["lighthouseResult"].isNull(), CAUSES[3])
    )


def read(rows: DataFrame, column: str = "psi_raw") -> tuple[DataFrame, DataFrame]:
    """The results with their metrics, and the rejected rows with their ``cause``: nothing that was sent is lost."""
    judged = rows.withColumn("cause", cause(column))
    return parse(judged.where("cause is null").drop("cause"), column), judged.where("cause is not null")


def rejected_by_cause(rejected: DataFrame) -> DataFrame:
    """cause, n of rejected rows; all causes, 0 where there is none."""
    spark = rejected.sparkSession
    names = spark.createDataFrame([(c,) for c in CAUSES], "cause string")
    return names.join(rejected.groupBy("cause").agg(F.count(F.lit(1)).alias("n")), "cause", "left").select("cause", F.coalesce("n", F.lit(0)).alias("n"))
