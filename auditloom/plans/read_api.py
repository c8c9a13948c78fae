"""Reads: audits and findings by page, with totals, bounds and ownership."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import STAGES, severity_rank

DEFAULT_LIMIT, MOST_LIMIT = 50, 200


def bounds(limit=None, offset=None) -> tuple[int, int]:
    """A limit from 1 to 200 (50 unless it is a number) and an offset of at least 0."""

    def number(x, default: int) -> int:
        try:
            value = float(x)
            return int(value) if math.isfinite(value) else default
        except (TypeError, ValueError):
            return default

    return min(MOST_LIMIT, max(1, number(limit, DEFAULT_LIMIT))), max(0, number(offset, 0))


def total_pages(total: int, size: int) -> int:
    return max(1, -(-total // size))


def bounded(limit: Column, offset: Column) -> tuple[Column, Column]:
    """``bounds`` of many requests at once: columns lim and off of limits and offsets given as text."""

    def number(x: Column, default: int) -> Column:
        value = x.try_cast("double")
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), default).otherwise(F.coalesce(value.cast("long"), F.lit(default)))

    lim = F.least(F.lit(MOST_LIMIT), F.greatest(F.lit(1), number(limit, DEFAULT_LIMIT)))
    return lim.cast("int").alias("lim"), F.greatest(F.lit(0), number(offset, 0)).cast("int").alias("off")


def pages_in(total: Column, size: Column) -> Column:
    """``total_pages`` of many totals at once."""
    return F.greatest(F.lit(1), F.ceil(total / size)).cast("long")


def owned(user_id: str | None, admin: bool = False, owner: str = "owner_id") -> Column:
    """Rows a user may see; rows without owner are for admins."""
    return F.lit(True) if admin else F.coalesce(F.col(owner) == user_id, F.lit(False))


def list_audits(audits: DataFrame, visible: Column, limit=None, offset=None) -> tuple[DataFrame, int]:
    """The newest audits of one page, and how many there are."""
    limit, offset = bounds(limit, offset)
    rows = audits.where(visible)
    return rows.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit), rows.count()


def matching(findings: DataFrame, severity: str | None = None, rule_id: str | None = None) -> DataFrame:
    """Findings of a severity or rule, or all."""
    for name, value in (("severity", severity), ("rule_id", rule_id)):
        findings = findings if value is None else findings.where(F.col(name) == value)
    return findings


def in_order(findings: DataFrame) -> DataFrame:
    """Gravest first, then by rule and URL; site-wide findings last."""
    return findings.orderBy(severity_rank(F.col("severity")), "rule_id", F.col("url").asc_nulls_last(), "detail")


def list_findings(findings: DataFrame, severity: str | None = None, rule_id: str | None = None, limit=None, offset=None) -> tuple[DataFrame, int]:
    """One page of findings in order, and the total of the same filter."""
    limit, offset = bounds(limit, offset)
    rows = matching(findings, severity, rule_id)
    return in_order(rows).offset(offset).limit(limit), rows.count()


def reports_ready(audits: DataFrame, recent: int = DEFAULT_LIMIT) -> DataFrame:
    """How many of the newest audits have a report."""
    return audits.orderBy(F.desc("created_at"), "id").limit(recent).agg(F.count_if(F.col("report_path").isNotNull()).alias("reports_ready"))


def stage_state(status: Column, stage: str) -> Column:
    """done, current, pending or failed: where a run of this status stands with a stage."""
    at = STAGES.index(stage)
    position = F.array_position(F.array(*map(F.lit, STAGES)), status) - 1
    return F.when(status == "failed", "failed").when((position > at) | (status == "done"), "done").when(position == at, "current").otherwise("pending")
