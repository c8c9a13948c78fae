"""Findings stored in reading order, so that a page of them reads one or two files.

The files are range partitions of the order of ``read_api.in_order``; a small index has
the number of findings of each rule in each file.  A severity or a rule is one run in
this order, so the index tells for any filter and offset which files hold the page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import FINDINGS, severity_rank
from . import read_api

#: Findings in one file, about.
FILE_ROWS = 200_000


def _order() -> list:
    return [severity_rank(F.col("severity")), F.col("rule_id"), F.col("url").asc_nulls_last(), F.col("detail")]


def store(findings: DataFrame, folder: str, file_rows: int = FILE_ROWS) -> None:
    """Write findings and their index to a new folder."""
    n = max(1, -(-findings.count() // file_rows))
    rows = findings.select(*FINDINGS.fieldNames()).repartitionByRange(n, *_order()).sortWithinPartitions(*_order())
    rows.withColumn("file", F.spark_partition_id()).write.partitionBy("file").parquet(f"{folder}/rows")
    spark = findings.sparkSession
    stored = spark.read.schema(T.StructType([*FINDINGS.fields, T.StructField("file", T.IntegerType())])).parquet(f"{folder}/rows")
    stored.groupBy("file", "severity", "rule_id").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{folder}/index")


class Pages:
    """Reads pages of stored findings."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        index = spark.read.schema("file int, severity string, rule_id string, n long").parquet(f"{folder}/index")
        # a row for each file, and one for each rule that begins in it
        self.index = [tuple(r) for r in index.orderBy(severity_rank(F.col("severity")), "rule_id", "file").collect()]

    def page(self, severity: str | None = None, rule_id: str | None = None, limit=None, offset=None) -> tuple[DataFrame, int]:
        """One page of findings in order, and the total of the same filter."""
        limit, offset = read_api.bounds(limit, offset)
        runs = [(file, n) for file, s, r, n in self.index if severity in (None, s) and rule_id in (None, r)]
        total, at, files = sum(n for _, n in runs), 0, []
        for file, n in runs:
            if at < offset + limit and at + n > offset and file not in files:
                files.append(file)
            at += n
        if not files:
            return self.spark.createDataFrame([], FINDINGS), total
        first = min(i for i, (file, _) in enumerate(runs) if file == files[0])
        before = sum(n for _, n in runs[:first])
        rows = self.spark.read.schema(FINDINGS).parquet(*[f"{self.folder}/rows/file={f}" for f in files])
        rows = read_api.matching(rows, severity, rule_id)
        return read_api.in_order(rows).offset(offset - before).limit(limit), total
