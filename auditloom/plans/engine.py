"""Findings: one pass over each table for the checks of single rows, one for the counts, a plan for each join; with their summaries."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.checks import REGISTRY, Check
from ..schemas import FINDINGS, SEVERITIES, severity_rank
from ..sources.tables import Tables, require_pages


@dataclass(frozen=True)
class Run:
    """Findings of the checks whose plans are valid, and the ids of the others."""

    findings: DataFrame
    failed: tuple[str, ...]


def _json(detail: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in detail.items()]), {"ignoreNullFields": "false"}) if detail else F.lit("{}")


def of_check(check: Check, tables: Tables) -> DataFrame:
    """A check's findings: audit_id, rule_id, severity, url, detail (JSON that keeps nulls)."""
    rows = check.plan(tables)
    detail = _json({c: F.col(c) for c in rows.columns if c not in ("audit_id", "url")})
    return rows.select("audit_id", F.lit(check.id).alias("rule_id"), F.lit(check.severity).alias("severity"), "url", detail.alias("detail"))


def local_findings(rows: DataFrame, checks: list[Check]) -> DataFrame:
    """Findings of checks that look at single rows of one table: each row yields an array of what is wrong with it."""
    found = []
    for check in checks:
        condition, detail = check.local.form()
        found.append(F.when(condition, F.struct(F.lit(check.id).alias("rule_id"), F.lit(check.severity).alias("severity"), F.col(check.local.url).alias("url"), _json(detail).alias("detail"))))
    each = rows.select("audit_id", F.explode(F.array_compact(F.array(*found))).alias("f")).select("audit_id", "f.*")
    return each.distinct() if checks[0].local.distinct else each


def counted_findings(pages: DataFrame, checks: list[Check]) -> DataFrame:
    """Findings of checks for live pages that share a key: all keys of a page at once, counted with partial sums and joined back."""
    keys = F.array(*[F.when(c.counted.key().isNotNull(), F.struct(F.lit(i).alias("check"), c.counted.key().alias("key"))) for i, c in enumerate(checks)])
    keyed = pages.where("status_class = '2xx'").select("audit_id", "url", F.explode(F.array_compact(keys)).alias("k")).select("audit_id", "url", "k.*")
    counts = keyed.groupBy("audit_id", "check", "key").agg(F.count(F.lit(1)).alias("duplicateCount")).where("duplicateCount > 1")
    detail = F.coalesce(*[F.when(F.col("check") == i, _json({c.counted.name: F.col("key"), "duplicateCount": F.col("duplicateCount")})) for i, c in enumerate(checks)])
    ids, severities = (F.element_at(F.array(*[F.lit(getattr(c, n)) for c in checks]), F.col("check") + 1) for n in ("id", "severity"))
    return keyed.join(counts, ["audit_id", "check", "key"]).select("audit_id", ids.alias("rule_id"), severities.alias("severity"), "url", detail.alias("detail"))


def _valid(part: Callable[[], DataFrame]) -> DataFrame | None:
    """The plan, or None if the analyser refuses it."""
    try:
        made = part()
        made.schema  # noqa: B018  the analyser speaks here, before anything runs
        return made
    except AnalysisException:
        return None


def run_checks(tables: Tables, registry: dict[str, Check] | None = None) -> Run:
    """Run a registry (all checks by default) as one plan; raises MissingStage without pages."""
    require_pages(tables.pages)
    groups: dict[tuple, list[Check]] = {}
    for check in (registry or REGISTRY).values():
        kind = ("local", check.local.table, check.local.distinct) if check.local else ("counted",) if check.counted else ("alone", check.id)
        groups.setdefault(kind, []).append(check)
    parts, failed = [], set()
    for (kind, *rest), checks in groups.items():

        def made(those: list[Check], kind=kind, rest=rest) -> DataFrame:
            if kind == "local":
                return local_findings(getattr(tables, rest[0]), those)
            return counted_findings(tables.pages, those) if kind == "counted" else of_check(those[0], tables)

        part = _valid(lambda: made(checks))
        if part is None:  # one of them at least is not valid: find out which
            valid = [c for c in checks if len(checks) > 1 and _valid(lambda c=c: made([c])) is not None]
            failed |= {c.id for c in checks} - {c.id for c in valid}
            part = _valid(lambda: made(valid)) if valid else None
        if part is not None:
            parts.append(part)
    empty = tables.pages.sparkSession.createDataFrame([], FINDINGS)
    return Run(functools.reduce(DataFrame.unionByName, parts or [empty]), tuple(c for c in (registry or REGISTRY) if (registry or REGISTRY)[c].id in failed))


def by_severity(findings: DataFrame) -> DataFrame:
    """severity, findings: all five severities, 0 where there is none."""
    spark = findings.sparkSession
    names = spark.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return names.join(findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("findings"))


def by_rule(findings: DataFrame) -> DataFrame:
    """rule_id, severity, findings."""
    return findings.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("findings"))


def by_rule_ordered(findings: DataFrame) -> DataFrame:
    """by_rule, gravest first, then the most frequent."""
    return by_rule(findings).orderBy(severity_rank(F.col("severity")), F.desc("findings"), "rule_id")


def shares(findings: DataFrame) -> DataFrame:
    """severity, findings, percent of all findings (0 without findings)."""
    counted = by_severity(findings)
    total = counted.agg(F.sum("findings").alias("total"))
    return counted.crossJoin(total).select("severity", "findings", F.when(F.col("total") > 0, F.col("findings") / F.col("total") * 100).otherwise(0.0).alias("percent"))  # a total of one row


def distinct_pages(findings: DataFrame) -> DataFrame:
    """Findings and distinct URLs of each rule."""
    return findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("url").alias("urls"))
