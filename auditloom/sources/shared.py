"""Written steps of the audit part, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import Files

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset a fresh temporary folder on a local master (tests), and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="auditloom-"))


class Step:
    """A written DataFrame: ``df`` reads it; ``drop`` deletes it once nothing reads it any more."""

    def __init__(self, df: DataFrame, label: str):
        self.path = f"{folder(df.sparkSession)}/auditloom-{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = df.sparkSession.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        Files(self.df.sparkSession, self.path).remove(self.path)


def numbered(rows: DataFrame, *order: str, start: int = 0) -> tuple[Step, int]:
    """Rows with ``place``, counted from ``start`` in the order of columns that tell all rows apart; and how many there are."""
    part, local = F.spark_partition_id(), F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": part, "__local": local.bitwiseAND((1 << 33) - 1)})
    step = Step(dealt, "numbered")
    before, total = {}, start
    for row in step.df.groupBy("__part").count().orderBy("__part").collect():  # one row for each range partition
        before[row["__part"]], total = total, total + row["count"]
    shift = rows.sparkSession.createDataFrame(list(before.items()), "__part int, __before long")
    placed = step.df.join(F.broadcast(shift), "__part").withColumn("place", F.col("__before") + F.col("__local")).drop("__part", "__local", "__before")
    done = Step(placed, "placed")
    step.drop()
    return done, total - start
