"""Declared schemas of every table, and the order of severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEVERITIES = ("critical", "high", "medium", "low", "info")
STATUS_CLASSES = ("2xx", "3xx", "4xx", "5xx")
STAGES = ("created", "crawling", "enriching", "analyzing", "measuring", "reporting", "done", "failed")

_HOP = T.StructType([T.StructField("url", T.StringType()), T.StructField("statusCode", T.IntegerType())])
_STRINGS = T.ArrayType(T.StringType())


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_S, _I, _B, _F = T.StringType(), T.IntegerType(), T.BooleanType(), T.FloatType()

PAGES = _table(
    audit_id=_S, url=_S, final_url=_S, status_code=_I, status_class=_S, redirect_chain=T.ArrayType(_HOP), content_type=_S,
    response_time_ms=_I, content_length_bytes=_I, depth=_I, crawl_source=_S, title=_STRINGS, meta_description=_STRINGS, h1=_STRINGS, h2=_STRINGS,
    canonical_url=_S, is_self_canonical=_B, meta_robots=_S, x_robots_tag=_S, blocked_by_robots_txt=_B, rel_next=_S, rel_prev=_S, content_hash=_S, inlink_count=_I,
)
LINKS = _table(audit_id=_S, source_url=_S, href=_S, anchor_text=_S, type=_S, rel=_STRINGS, target_status_code=_I, is_redirect=_B, is_broken=_B)
IMAGES = _table(audit_id=_S, page_url=_S, src=_S, alt=_S, title=_S, status_code=_I)
HREFLANG = _table(audit_id=_S, page_url=_S, lang=_S, href=_S, is_reciprocal=_B)
PERFORMANCE = _table(
    audit_id=_S, page_url=_S, strategy=_S, lcp_ms=_I, cls=_F, inp_ms=_I, performance_score=_F, fcp_ms=_I, tbt_ms=_I, speed_index_ms=_I, usability_flags=_STRINGS, psi_raw=_S
)
REJECTED = _table(audit_id=_S, page_url=_S, strategy=_S, psi_raw=_S, cause=_S)
FINDINGS = _table(audit_id=_S, rule_id=_S, severity=_S, url=_S, detail=_S)
AUDITS = _table(id=_S, start_url=_S, status=_S, owner_id=_S, report_path=_S, created_at=T.TimestampNTZType())
ATTEMPTS = _table(email=_S, success=_B, created_at=T.TimestampNTZType())
PSI = T.StructType().add("loadingExperience", T.StructType().add("metrics", T.MapType(_S, T.StructType().add("percentile", T.DoubleType())))).add(
    "lighthouseResult",
    T.StructType()
    .add("categories", T.MapType(_S, T.StructType().add("score", T.DoubleType()).add("auditRefs", T.ArrayType(T.StructType().add("id", _S)))))
    .add("audits", T.MapType(_S, T.StructType().add("score", T.DoubleType()).add("numericValue", T.DoubleType()))),
)


def severity_rank(column: Column) -> Column:
    """0 for critical to 4 for info; unknown severities come last."""
    rank = F.lit(len(SEVERITIES))
    for i, name in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(column == name, i).otherwise(rank)
    return rank
