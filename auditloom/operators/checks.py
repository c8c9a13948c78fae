"""The 31 checks: a registry of declarative plans, each giving ``audit_id``, ``url`` and its detail columns.

A check is registered with its id, severity and description; anything that has the
same shape can be added to a copy of the registry and run by the engine.  Checks that
look at one row, or at how often a key occurs, also say so (``local``, ``counted``):
the engine runs all of these that read one table in one pass over it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Tables
from .enrich import is_loop


@dataclass(frozen=True)
class Local:
    """What a check looks for in single rows of one table: ``form`` gives the condition and the detail columns; ``distinct`` findings are reported once."""

    table: str
    form: Callable[[], tuple[Column, dict[str, Column]]]
    url: str = "url"
    distinct: bool = False


@dataclass(frozen=True)
class Counted:
    """A check for pages that share a key (null: none): ``name`` is the key's column in the details."""

    key: Callable[[], Column]
    name: str


@dataclass(frozen=True)
class Check:
    """A check: its plan maps tables to ``audit_id``, ``url`` and detail columns (named as in the findings' JSON)."""

    id: str
    severity: str
    description: str
    plan: Callable[[Tables], DataFrame]
    local: Local | None = None
    counted: Counted | None = None


REGISTRY: dict[str, Check] = {}


def _check(check_id: str, severity: str, description: str):
    def add(plan: Callable[[Tables], DataFrame]):
        REGISTRY[check_id] = Check(check_id, severity, description, plan)
        return plan

    return add


def _row(check_id: str, severity: str, description: str, table: str, url: str = "url", distinct: bool = False):
    """Register a check of single rows: its function gives the condition and the detail columns."""

    def add(form: Callable[[], tuple[Column, dict[str, Column]]]):
        def plan(t: Tables) -> DataFrame:
            found, detail = form()
            rows = getattr(t, table).where(found).select("audit_id", F.col(url).alias("url"), *[c.alias(n) for n, c in detail.items()])
            return rows.distinct() if distinct else rows

        REGISTRY[check_id] = Check(check_id, severity, description, plan, local=Local(table, form, url, distinct))
        return form

    return add


def _same(check_id: str, severity: str, description: str, name: str):
    """Register a check for live pages that share a key."""

    def add(key: Callable[[], Column]):
        def plan(t: Tables) -> DataFrame:
            return _shared(_ok(t), key()).select("audit_id", "url", F.col("key").alias(name), "duplicateCount")

        REGISTRY[check_id] = Check(check_id, severity, description, plan, counted=Counted(key, name))
        return key

    return add


def _live() -> Column:
    return F.col("status_class") == "2xx"


def _ok(t: Tables) -> DataFrame:
    return t.pages.where(_live())


def _labels(**cases: Column) -> Column:
    """The names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n.replace("_", "-"))) for n, c in cases.items()]))


def _shared(rows: DataFrame, key: Column) -> DataFrame:
    """Rows whose key is not null and occurs more than once in the audit, with ``key`` and ``duplicateCount``: counted with partial sums, then joined back."""
    keyed = rows.select("audit_id", "url", key.alias("key")).where(F.col("key").isNotNull())
    counts = keyed.groupBy("audit_id", "key").agg(F.count(F.lit(1)).alias("duplicateCount")).where("duplicateCount > 1")
    return keyed.join(counts, ["audit_id", "key"])


# --- mirrors -----------------------------------------------------------------


@_check("mirror.main-mirror", "high", "The site answers on several scheme or www variants")
def main_mirror(t: Tables) -> DataFrame:
    key = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"^www\.", "")
    rows = _ok(t).select("audit_id", "url", key.alias("variantKey"), F.regexp_replace("url", "(^https?://[^/]+).*", "$1").alias("origin"))
    groups = rows.groupBy("audit_id", "variantKey").agg(F.sort_array(F.collect_set("origin")).alias("variants")).where(F.size("variants") > 1)
    return rows.join(groups, ["audit_id", "variantKey"]).select("audit_id", "url", "variantKey", "variants", F.size("variants").cast("long").alias("mirrorCount"))


@_check("mirror.trailing-slash", "medium", "A page and its form with a trailing slash have the same content")
def trailing_slash(t: Tables) -> DataFrame:
    bare = _ok(t).where(~F.col("url").endswith("/") & F.col("content_hash").isNotNull()).select("audit_id", "url", F.concat("url", F.lit("/")).alias("slashUrl"), F.col("content_hash").alias("contentHash"))
    slashed = _ok(t).select("audit_id", F.col("url").alias("slashUrl"), F.col("content_hash").alias("contentHash"))
    return bare.join(slashed, ["audit_id", "slashUrl", "contentHash"]).select("audit_id", "url", "slashUrl", "contentHash")


# --- links -------------------------------------------------------------------


def _link(kind: str, flag: str) -> tuple[Column, dict[str, Column]]:
    return (F.col("type") == kind) & F.col(flag), {"href": F.col("href"), "targetStatusCode": F.col("target_status_code")}


@_row("links.internal-redirect", "high", "Internal links that lead to a redirect", "links", "source_url", distinct=True)
def internal_redirect():
    return _link("internal", "is_redirect")


@_row("links.redirect-chain", "high", "Pages reached through several hops, or in a loop", "pages")
def redirect_chain():
    hops = F.array_size("redirect_chain")
    return hops > 1, {"hops": hops.cast("long"), "isLoop": is_loop(), "chain": F.col("redirect_chain")}


@_row("links.broken-internal", "critical", "Internal links whose target answers 4xx or 5xx", "links", "source_url", distinct=True)
def broken_internal():
    return _link("internal", "is_broken")


@_row("links.broken-external", "medium", "External links whose crawled target answers 4xx or 5xx", "links", "source_url", distinct=True)
def broken_external():
    return _link("external", "is_broken")


@_row("links.external-flag", "low", "External links without nofollow, sponsored or ugc", "links", "source_url", distinct=True)
def external_flag():
    flagged = F.coalesce(F.arrays_overlap("rel", F.array(*map(F.lit, ("nofollow", "sponsored", "ugc")))), F.lit(False))
    return (F.col("type") == "external") & ~flagged, {"href": F.col("href"), "rel": F.col("rel")}


# --- titles, descriptions, headings ------------------------------------------


def _element_checks(name: str, column: str, key: str, severities: tuple[str, str, str, str], shortest: int, longest: int) -> None:
    """Missing, duplicate, multiple and ill-sized values of one array column."""

    def first() -> Column:
        return F.get(column, 0)

    @_row(f"meta.{name}.missing", severities[0], f"Pages without {name}", "pages")
    def missing():
        return _live() & (F.array_size(column) == 0), {}

    @_same(f"meta.{name}.duplicate", severities[1], f"Pages that share their {name}", key)
    def duplicate():
        return F.when(F.array_size(column) >= 1, first())

    @_row(f"meta.{name}.multiple", severities[2], f"Pages with more than one {name}", "pages")
    def multiple():
        return _live() & (F.array_size(column) > 1), {f"{key}s": F.col(column), "count": F.array_size(column).cast("long")}

    @_row(f"meta.{name}.template", severities[3], f"Pages whose {name} is shorter than {shortest} or longer than {longest} characters", "pages")
    def template():
        length = F.char_length(first()).cast("long")
        return _live() & ~length.between(shortest, longest), {key: first(), "length": length, "recommendation": F.when(length < shortest, "too-short").otherwise("too-long")}


_element_checks("title", "title", "title", ("high", "medium", "medium", "info"), 30, 60)
_element_checks("description", "meta_description", "description", ("medium", "low", "low", "info"), 70, 160)
_element_checks("h1", "h1", "h1", ("high", "low", "medium", "info"), 20, 70)


# --- duplicates and indexing ---------------------------------------------------


@_same("dupe.content", "high", "Pages with the same content", "contentHash")
def duplicate_content():
    return F.col("content_hash")


@_row("index.canonical", "high", "Pages without canonical URL, or with that of another page", "pages")
def canonical():
    issue = F.when(F.col("canonical_url").isNull(), "missing").when(~F.col("is_self_canonical"), "non-self")
    return _live() & issue.isNotNull(), {"issue": issue, "canonicalUrl": F.col("canonical_url")}


@_row("index.robots", "high", "Live pages that are kept out of the index", "pages")
def robots():
    no = F.lit(False)
    reason = _labels(
        meta_noindex=F.coalesce(F.col("meta_robots").ilike("%noindex%"), no),
        header_noindex=F.coalesce(F.col("x_robots_tag").ilike("%noindex%"), no),
        robots_txt_blocked=F.coalesce(F.col("blocked_by_robots_txt"), no),
    )
    return _live() & (F.size(reason) > 0), {"reason": reason, "metaRobots": F.col("meta_robots"), "xRobotsTag": F.col("x_robots_tag"), "blockedByRobotsTxt": F.col("blocked_by_robots_txt")}


@_row("index.url-heuristics", "low", "URLs with capitals, underscores, parameters, or of great length", "pages")
def url_heuristics():
    path = F.regexp_replace("url", "^https?://[^/]+", "")
    issues = _labels(uppercase=path.rlike("[A-Z]"), underscore=F.contains(path, F.lit("_")), query_params=F.contains("url", F.lit("?")), too_long=F.char_length("url") > 115)
    return _live() & (F.size(issues) > 0), {"issues": issues}


@_check("pagination.rel", "medium", "rel=next targets that are missing or do not point back")
def pagination(t: Tables) -> DataFrame:
    rows = _ok(t).where(F.col("rel_next").isNotNull()).select("audit_id", "url", F.col("rel_next").alias("relNext"))
    target = _ok(t).select("audit_id", F.col("url").alias("relNext"), F.col("rel_prev").alias("back"), F.lit(True).alias("found"))
    issue = F.when(F.col("found").isNull(), "next-target-missing").when(~F.col("back").eqNullSafe(F.col("url")), "next-not-reciprocal")
    return rows.join(target, ["audit_id", "relNext"], "left").select("audit_id", "url", "relNext", issue.alias("issue")).where("issue is not null")


@_row("i18n.hreflang", "medium", "Alternates that do not point back, or with an invalid language", "hreflang", "page_url")
def hreflang():
    valid = (F.col("lang") == "x-default") | F.col("lang").rlike("(?i)^[a-z]{2,3}(-[a-z0-9]{2,8})*$")
    issue = F.concat_ws(",", _labels(non_reciprocal=~F.coalesce(F.col("is_reciprocal"), F.lit(False)), invalid_lang=~valid))
    return issue != "", {"lang": F.col("lang"), "href": F.col("href"), "issue": issue}


# --- images --------------------------------------------------------------------


@_row("image.alt-title", "low", "Images without alternative text", "images", "page_url", distinct=True)
def alt_title():
    alt = F.col("alt")
    return alt.isNull() | (alt == ""), {"src": F.col("src"), "alt": alt, "altState": F.when(alt.isNull(), "missing").otherwise("empty")}


@_row("image.broken", "medium", "Images that answer 4xx or 5xx", "images", "page_url", distinct=True)
def image_broken():
    return F.col("status_code") >= 400, {"src": F.col("src"), "statusCode": F.col("status_code")}


# --- performance -----------------------------------------------------------------


@_row("perf.lcp", "high", "Largest contentful paint above 2500 ms", "performance", "page_url")
def lcp():
    return F.col("lcp_ms") > 2500, {"strategy": F.col("strategy"), "lcpMs": F.col("lcp_ms")}


@_row("perf.cls-inp", "high", "Layout shift above 0.1 or interaction delay above 200 ms", "performance", "page_url")
def cls_inp():
    # the label looks at the decimal value: a shift of exactly 0.1 is a finding without a label
    decimal = F.col("cls").cast("string").cast("double")
    issues = _labels(cls=F.coalesce(decimal > 0.1, F.lit(False)), inp=F.coalesce(F.col("inp_ms") > 200, F.lit(False)))
    found = (F.col("cls").cast("double") > 0.1) | (F.col("inp_ms") > 200)
    return found, {"strategy": F.col("strategy"), "cls": F.col("cls"), "inpMs": F.col("inp_ms"), "issues": issues}


def _flagged() -> tuple[Column, dict[str, Column]]:
    return F.array_size("usability_flags") > 0, {"strategy": F.col("strategy"), "flags": F.col("usability_flags")}


@_row("perf.psi-usability", "medium", "Pages with usability flags", "performance", "page_url")
def psi_usability():
    return _flagged()


@_row("perf.mobile-indexing", "high", "Pages with usability flags on mobile", "performance", "page_url")
def mobile_indexing():
    found, detail = _flagged()
    return found & (F.col("strategy") == "mobile"), detail
