"""Tables of an audit: scoped reads, guards, and the sink that replaces an audit's rows."""

from __future__ import annotations

from dataclasses import dataclass, replace
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .versions import Files


@dataclass(frozen=True)
class Tables:
    """The DataFrames that enrichment and checks read."""

    pages: DataFrame
    links: DataFrame
    images: DataFrame
    hreflang: DataFrame
    performance: DataFrame

    def with_(self, **changed: DataFrame) -> Tables:
        return replace(self, **changed)


_NAMES = {"pages": schemas.PAGES, "links": schemas.LINKS, "images": schemas.IMAGES, "hreflang": schemas.HREFLANG, "performance": schemas.PERFORMANCE}


class MissingStage(ValueError):
    """A stage has no rows to work on; the message names the stage to run first."""


def read(spark: SparkSession, folder: str, audit_id: str) -> Tables:
    """An audit's tables; folders are partitioned by audit_id, so only its partitions are read."""
    return Tables(**{n: spark.read.schema(s).parquet(f"{folder}/{n}").where(F.col("audit_id") == audit_id) for n, s in _NAMES.items()})


def write(df: DataFrame, path: str, *audits: str) -> None:
    """Replace the rows of the audits in ``df`` and of those named (to none, if ``df`` has none of theirs); other audits stay.  ``versions`` does the same for several tables at once."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("audit_id").parquet(path)
    there = {unquote(n.partition("=")[2]): n for n in Files(df.sparkSession, path).names(path) if n.startswith("audit_id=")}
    named = [a for a in audits if a in there]
    if named:
        kept = {r["audit_id"] for r in df.where(F.col("audit_id").isin(*named)).select("audit_id").distinct().collect()}  # of the audits named
        for audit in set(named) - kept:
            Files(df.sparkSession, path).remove(f"{path}/{there[audit]}")


def require_pages(pages: DataFrame, stage: str = "crawl") -> None:
    if not exists(pages):
        raise MissingStage(f"no crawled pages: run the {stage} stage first")


def exists(df: DataFrame) -> bool:
    """Whether there is a row; reads one."""
    return not df.isEmpty()
