"""Enrichment: link targets, inlink counts, reciprocity, image status, and the merge of live link checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Tables, require_pages
from .skew import left_join


def resolve_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Target status and the redirect and broken flags; null where the target was not crawled."""
    target = pages.select("audit_id", F.col("url").alias("href"), F.col("status_code").alias("target_status_code"), "status_class")
    bare = left_join(links.drop("target_status_code", "is_redirect", "is_broken"), target, ["audit_id", "href"])
    kind = F.col("status_class")
    flags = {"is_redirect": kind == "3xx", "is_broken": kind.isin("4xx", "5xx")}
    return bare.withColumns(flags).drop("status_class").select("audit_id", "source_url", "href", "anchor_text", "type", "rel", "target_status_code", "is_redirect", "is_broken")


def count_inlinks(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Internal links to each page, every occurrence, 0 for none."""
    n = links.where(F.col("type") == "internal").groupBy("audit_id", F.col("href").alias("url")).agg(F.count(F.lit(1)).alias("__n"))
    return pages.join(n, ["audit_id", "url"], "left").withColumn("inlink_count", F.coalesce("__n", F.lit(0)).cast("int")).drop("__n").select(*pages.columns)


def reciprocity(hreflang: DataFrame) -> DataFrame:
    """Whether the alternate points back."""
    back = hreflang.select("audit_id", F.col("href").alias("page_url"), F.col("page_url").alias("href"), F.lit(True).alias("__back")).distinct()
    return hreflang.join(back, ["audit_id", "page_url", "href"], "left").withColumn("is_reciprocal", F.coalesce("__back", F.lit(False))).select(*hreflang.columns)


def image_status(images: DataFrame, pages: DataFrame) -> DataFrame:
    """The status of images that were crawled."""
    target = pages.select("audit_id", F.col("url").alias("src"), F.col("status_code").alias("__code"))
    return left_join(images, target, ["audit_id", "src"]).withColumn("status_code", F.col("__code")).select(*images.columns)


def enrich(tables: Tables) -> Tables:
    """All four updates; raises MissingStage without pages."""
    require_pages(tables.pages)
    links = resolve_links(tables.links, tables.pages)
    return tables.with_(links=links, pages=count_inlinks(tables.pages, tables.links), hreflang=reciprocity(tables.hreflang), images=image_status(tables.images, tables.pages))


def is_loop(chain="redirect_chain"):
    """A chain that visits a URL twice."""
    return F.size(chain) > F.size(F.array_distinct(F.transform(chain, lambda h: h["url"])))


def summary(tables: Tables) -> DataFrame:
    """The eight counts of enrichment, one aggregate per table."""
    of = lambda df, **counts: df.agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    links = of(tables.links, links_resolved=F.col("target_status_code").isNotNull(), links_redirect=F.col("is_redirect"), links_broken=F.col("is_broken"))
    pages = of(tables.pages, pages_with_inlinks=F.col("inlink_count") > 0, redirect_chain_pages=F.size("redirect_chain") > 1, redirect_loop_pages=(F.size("redirect_chain") > 1) & is_loop())
    images = of(tables.images, images_resolved=F.col("status_code").isNotNull())
    alternates = of(tables.hreflang, hreflang_reciprocal=F.col("is_reciprocal"))
    return links.crossJoin(pages).crossJoin(images).crossJoin(alternates)  # four tables of one row


def verify_candidates(links: DataFrame, most: int = 500) -> DataFrame:
    """Distinct broken targets to fetch again: the first ``most + 1`` by name, of these the http(s) ones, at most ``most``."""
    first = links.where("is_broken").select("href").distinct().orderBy("href").limit(most + 1)
    return first.where(F.col("href").rlike("^https?://")).orderBy("href").limit(most)


def verify_outcome(status):
    """healthy for 2xx and 3xx, broken for other statuses, inconclusive without one."""
    return F.when(status.isNull(), "inconclusive").when(status.between(200, 399), "healthy").otherwise("broken")


def merge_verified(links: DataFrame, results: DataFrame) -> DataFrame:
    """Links after a live check (href, status): healthy ones lose the broken flag, broken ones take the fresh code, others stay as they are."""
    checked = results.select("href", F.col("status").alias("__status"), verify_outcome(F.col("status")).alias("__outcome"))
    joined = left_join(links, checked, ["href"])
    outcome, status = F.col("__outcome"), F.col("__status").cast("int")
    return joined.withColumns({
        "target_status_code": F.when(outcome.isin("healthy", "broken"), status).otherwise(F.col("target_status_code")),
        "is_redirect": F.when(outcome == "healthy", status >= 300).otherwise(F.col("is_redirect")),
        "is_broken": F.when(outcome == "healthy", F.lit(False)).otherwise(F.col("is_broken")),
    }).select(*links.columns)
