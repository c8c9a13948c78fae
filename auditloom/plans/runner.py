"""An audit from crawled rows to its report, stage by stage, over versioned tables.

Each stage reads what the stages before it wrote, switches to its own rows in all of
its tables at once, and leaves a numbered entry in the audit's status log.  A stage
that fails leaves ``failed`` with its name, and no later stage runs; what it had not
finished is never read.  A stage can be run again: its rows are replaced, also by
none.  Of two runs of one audit at once, the one that finds the log changed under it
ends with a ``Conflict``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import enrich, perf
from ..operators.checks import REGISTRY
from ..sources import html, psi, tables
from ..sources.versions import Conflict, Log, Versions
from . import engine, report

STATUS = "audit_id string, status string, stage string, note string"
PERF_CHECKS = {k: c for k, c in REGISTRY.items() if k.startswith("perf.")}
#: Statuses that a run may start from.
_RESTING = ("created", "done", "failed")
_KINDS = {"pages": schemas.PAGES, "links": schemas.LINKS, "images": schemas.IMAGES, "hreflang": schemas.HREFLANG}


class Audit:
    """One audit in a folder of tables that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, audit_id: str, start_url: str = ""):
        self.spark, self.folder, self.id, self.start_url = spark, folder.rstrip("/"), audit_id, start_url
        self.versions = Versions(spark, f"{self.folder}/tables")
        self._log, self._at = Log(spark, f"{self.folder}/status/{quote(audit_id, safe='')}"), None

    # --- tables ------------------------------------------------------------------

    def _put(self, **rows: DataFrame) -> None:
        self.versions.write(self.id, rows)

    def _get(self, name: str, schema) -> DataFrame:
        return self.versions.read(name, schema, self.id)

    def _tables(self, step: str) -> tables.Tables:
        return tables.Tables(**{n: self._get(f"{step}_{n}", s) for n, s in _KINDS.items()}, performance=self._get("performance", schemas.PERFORMANCE))

    def findings(self) -> DataFrame:
        return self._get("findings", schemas.FINDINGS)

    def rejected(self) -> DataFrame:
        """PageSpeed bodies that were no results, with their causes."""
        return self._get("rejected", schemas.REJECTED)

    # --- stages ------------------------------------------------------------------

    def crawl(self, crawled: DataFrame) -> None:
        """Pages, links, images and alternates of crawled rows (url, html; optional final_url, status_code, headers, depth, crawl_source, fetched)."""
        found = html.extract(crawled.withColumn("audit_id", F.lit(self.id)))
        self._put(crawled_pages=html.to_pages(found), crawled_links=html.to_links(found), crawled_images=html.to_images(found), crawled_hreflang=html.to_hreflang(found))

    def enrich(self) -> None:
        done = enrich.enrich(self._tables("crawled"))
        self._put(**{f"enriched_{n}": getattr(done, n) for n in _KINDS})

    def analyze(self) -> tuple[str, ...]:
        """Findings of all checks; returns the ids of those whose plan failed."""
        ran = engine.run_checks(self._tables("enriched"))
        self._put(findings=ran.findings)
        return ran.failed

    def measure(self, results: DataFrame) -> dict[str, int]:
        """PageSpeed results (page_url, strategy, psi_raw) of the sampled pages, and the performance findings anew; returns how many were asked for, cached, fetched and failed."""
        old = self._get("performance", schemas.PERFORMANCE)
        wanted = perf.pairs(perf.samples(perf.candidates(self._tables("enriched").pages)))
        kept = results.join(wanted.select(F.col("url").alias("page_url"), "strategy"), ["page_url", "strategy"], "left_semi")
        fresh, rejected = psi.read(kept.withColumn("audit_id", F.lit(self.id)).select("audit_id", "page_url", "strategy", "psi_raw"))
        errors = rejected.select("page_url", "strategy", F.col("cause").alias("error"))
        runs = fresh.select("page_url", "strategy", F.lit(None).cast("string").alias("error")).unionByName(errors)
        counts = perf.outcome(runs, wanted, old).first()
        fresh, rejected = fresh.select(*schemas.PERFORMANCE.fieldNames()), rejected.select(*schemas.REJECTED.fieldNames())
        self.versions.upsert(self.id, "performance", fresh, ["audit_id", "page_url", "strategy"], perf.upsert, schemas.PERFORMANCE, {"rejected": rejected})
        of_perf = engine.run_checks(self._tables("enriched"), PERF_CHECKS).findings
        self._put(findings=perf.refresh(self.findings(), of_perf))
        return counts.asDict()

    def report(self, folder: str, generated: dt.datetime) -> str:
        return report.build_workbook(self.findings(), {"id": self.id, "start_url": self.start_url, "status": "reporting"}, folder, generated)

    # --- the run -----------------------------------------------------------------

    def _enter(self, status: str, stage: str, note: str | None = None) -> None:
        """Add an entry after this run's last one."""
        self._at = self._log.append({"audit_id": self.id, "status": status, "stage": stage, "note": note}, self._at)

    def _begin(self, take_over: bool) -> None:
        self._at, last = self._log.last()
        if not take_over and last.get("status", "created") not in _RESTING:
            raise Conflict(f"audit {self.id} is {last['status']}: another run is at work, or one has died (take_over=True goes on from there)")

    def _stage(self, status: str, name: str, work: Callable[[], object]) -> object:
        self._enter(status, name)
        try:
            return work()
        except Conflict:
            raise
        except Exception as e:
            self._enter("failed", name, f"{type(e).__name__}: {e}"[:1000])
            raise

    def run(self, crawled: DataFrame, results: DataFrame, report_folder: str, generated: dt.datetime, take_over: bool = False) -> str:
        """All stages in order; returns the report's path.  ``take_over``: also where the last run never came to its end."""
        self._begin(take_over)
        self._stage("crawling", "crawl", lambda: self.crawl(crawled))
        self._stage("enriching", "enrich", self.enrich)
        failed = self._stage("analyzing", "analyze", self.analyze)
        if failed:
            self._enter("analyzing", "analyze", f"rules_failed={len(failed)}: {', '.join(failed)}")
        counts = self._stage("measuring", "perf", lambda: self.measure(results))
        self._enter("measuring", "perf", " ".join(f"{k}={v}" for k, v in counts.items()))
        path = self._stage("reporting", "report", lambda: self.report(report_folder, generated))
        self._enter("done", "report", path)
        return path


def history(spark: SparkSession, folder: str) -> DataFrame:
    """audit_id, n, status, stage, note: all entries of all audits' logs, numbered from 1 in each."""
    found = spark.read.schema(STATUS).json(f"{folder.rstrip('/')}/status/*/*.json").select("*", F.col("_metadata.file_name").alias("file"))
    return found.select("audit_id", F.regexp_extract("file", r"^(\d+)", 1).cast("long").alias("n"), "status", "stage", "note")


def statuses(spark: SparkSession, folder: str) -> DataFrame:
    """audit_id, status, stage, note: the last entry of every audit."""
    last = history(spark, folder).groupBy("audit_id").agg(F.max(F.struct("n", "status", "stage", "note")).alias("last"))
    return last.select("audit_id", "last.status", "last.stage", "last.note")
