"""Crawl-shaped tables derived from the test data by arithmetic on page ids.

The raw pages have titles, headings and links only; these views add what the other
checks look at (status codes, canonical URLs, alternates, images, performance), so
that every check has rows.  The same views exist as DuckDB SQL in ``plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.urls import without_fragment
from . import html
from .tables import Tables

AUDIT = "demo"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, u (URL without fragment), t (title), h (heading) of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    t, h = F.get(html.titles(F.col("html")), 0), F.get(html.headings(F.col("html")), 0)
    return pages.select(F.col("page_id").alias("i"), without_fragment(F.col("url")).alias("u"), tx.decode_basic(t).alias("t"), tx.decode_basic(h).alias("h"))


def real_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw pages as a pages table: every page 200, titles and headings as extracted."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = html.titles(F.col("html")), html.headings(F.col("html"))
    decoded = [F.transform(x, lambda v: tx.decode_basic(v)) for x in found]
    return pages.select(F.lit(AUDIT).alias("audit_id"), without_fragment(F.col("url")).alias("url"), F.lit("2xx").alias("status_class"), decoded[0].alias("title"), decoded[1].alias("h1"), "page_id")


def _three(i: Column, mod: int, value: Column, doubled: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(i % mod == 0, none).when(i % mod == 1, F.array(value, F.concat(value, F.lit(" 2")))).when(i % mod == 2, F.array(doubled)).otherwise(F.array(value))


def demo_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The derived tables, links and images and alternates not yet enriched."""
    base = raw(spark, sf_dir)
    n = base.count()
    i, u, t, h = (F.col(c) for c in "iuth")
    url_of = base.select(F.col("i").alias("of"), F.col("u").alias("there"))

    def pointing(rows: DataFrame, index: Column, name: str) -> DataFrame:
        """The URL of page ``index`` (null index: null)."""
        at = url_of.select(F.col("of").alias("__of"), F.col("there").alias(name))
        return rows.withColumn("__at", index).join(at, F.col("__at") == F.col("__of"), "left").drop("__at", "__of")

    code = F.when(i % 20 == 3, 301).when(i % 20 == 7, 404).when(i % 20 == 13, 500).otherwise(200)
    swapped = F.when(u.startswith("https://"), F.concat(F.lit("http://"), F.substring(u, 9, 100_000))).otherwise(F.concat(F.lit("https://"), F.substring(u, 8, 100_000)))
    kinds = F.array_compact(F.array(
        F.struct(F.lit(0).alias("kind"), u.alias("url"), code.alias("status_code")),
        F.when(i % 15 == 2, F.struct(F.lit(1).alias("kind"), swapped.alias("url"), F.lit(200).alias("status_code"))),
        F.when((i % 5 == 1) & ~F.contains(u, F.lit("?")) & ~u.endswith("/"), F.struct(F.lit(2).alias("kind"), F.concat(u, F.lit("/")).alias("url"), F.lit(200).alias("status_code"))),
    ))
    rows = base.withColumn("k", F.explode(kinds)).select("i", "t", "h", "k.*")
    place = F.row_number().over(Window.partitionBy("url").orderBy("kind", "i"))
    rows = rows.withColumn("place", place).where("place = 1").drop("place")
    first = F.col("kind") == 0
    rows = pointing(rows, F.when((i % 6 == 1) | ((i % 10 < 5) & first), (i + 1) % n), "u_next")
    rows = pointing(rows, F.when(first & (i % 10).between(1, 5) & (i % 10 != 2), (i - 1 + n) % n), "rel_prev")
    rows = pointing(rows, F.when((i % 25 == 4) | (i % 50 == 9), (i + 1) % n), "u_hop")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("d"), F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256).alias("content_hash"))
    rows = rows.withColumn("d0", F.when(i % 9 == 1, i - 1).otherwise(i)).join(docs, F.col("d0") == F.col("d"), "left").drop("d", "d0")
    hop = lambda x, c: F.struct(x.alias("url"), F.lit(c).alias("statusCode"))
    url, nxt, hp = F.col("url"), F.col("u_next"), F.col("u_hop")
    canonical = F.when(i % 6 == 0, None).when(i % 6 == 1, nxt).otherwise(url)
    pages = rows.select(
        F.lit(AUDIT).alias("audit_id"), "url", "status_code", tx.status_class(F.col("status_code")).alias("status_class"),
        F.when(i % 25 == 4, F.array(hop(url, 301), hop(hp, 200))).when(i % 50 == 9, F.array(hop(url, 301), hop(hp, 301), hop(url, 200))).otherwise(F.array().cast("array<struct<url:string,statusCode:int>>")).alias("redirect_chain"),
        F.lit("text/html; charset=utf-8").alias("content_type"), (i % 4).cast("int").alias("depth"),
        _three(i, 17, t, F.concat(t, F.lit(" "), t)).alias("title"),
        _three(i, 11, t, F.concat(*[F.concat(t, F.lit(" "))] * 4)).alias("meta_description"),
        _three(i, 19, h, F.concat(h, F.lit(" "), h)).alias("h1"),
        canonical.alias("canonical_url"), (canonical == url).alias("is_self_canonical"),
        F.when(i % 13 == 0, "NoIndex, follow").otherwise("index, follow").alias("meta_robots"), F.when(i % 29 == 1, "noindex").alias("x_robots_tag"), (i % 31 == 2).alias("blocked_by_robots_txt"),
        F.when((i % 10 < 5) & first, nxt).alias("rel_next"), "rel_prev", "content_hash", F.lit(0).alias("inlink_count"),
    )
    none, flag = F.lit(None).cast("int"), F.lit(None).cast("boolean")
    rel = F.when(i % 3 == 0, F.array(F.lit("nofollow"))).when(i % 3 == 1, F.array(F.lit("noopener"))).otherwise(F.array().cast("array<string>"))
    each = base.select("i", "u").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    inside = pointing(each, (7 * i + 3 * F.col("k")) % n, "href").select("u", "href", F.when(i % 4 == 0, "external").otherwise("internal").alias("type"), rel.alias("rel"))
    outside = base.select("u", F.concat(F.lit("https://uncrawled.example.org/"), i.cast("string")).alias("href"), F.lit("external").alias("type"), F.array(F.lit("ugc")).alias("rel"))
    links = inside.unionByName(outside).select(F.lit(AUDIT).alias("audit_id"), F.col("u").alias("source_url"), "href", F.lit(None).cast("string").alias("anchor_text"), "type", "rel", none.alias("target_status_code"), flag.alias("is_redirect"), flag.alias("is_broken"))
    images = pointing(base.select("i", "u"), (3 * i + 1) % n, "src").select(F.lit(AUDIT).alias("audit_id"), F.col("u").alias("page_url"), "src", F.when(i % 3 == 1, "").when(i % 3 == 2, "alt").alias("alt"), F.lit(None).cast("string").alias("title"), none.alias("status_code"))
    to = F.when(i % 2 == 0, i + 1).when(i % 4 == 1, i - 1).otherwise((i + 2) % n)
    lang = F.when(i % 8 == 5, "EN_us").when(i % 8 == 6, "x-default").otherwise("en-US")
    alternates = pointing(base.where(i < n - 1).select("i", "u"), to, "href").select(F.lit(AUDIT).alias("audit_id"), F.col("u").alias("page_url"), lang.alias("lang"), "href", flag.alias("is_reciprocal"))
    return Tables(pages, links, images, alternates, performance(spark, sf_dir, url_of, n))


def performance(spark: SparkSession, sf_dir: str, url_of: DataFrame, n: int) -> DataFrame:
    """Metrics per page and strategy from the events' values, in whole cents so that sums are exact."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cents = F.floor(F.col("value") * 100).cast("long")
    rows = events.select((F.col("user_id") % n).alias("i"), F.when(F.col("event_id") % 2 == 0, "mobile").otherwise("desktop").alias("strategy"), cents.alias("c"), "event_type", "value")
    grouped = rows.groupBy("i", "strategy").agg(F.sum("c").alias("s"), F.count(F.lit(1)).alias("m"), F.min("c").alias("least"), F.array_sort(F.collect_set(F.when(F.col("value") > 200, F.col("event_type")))).alias("flags"))
    found = grouped.join(url_of, F.col("i") == F.col("of"))
    return found.select(
        F.lit(AUDIT).alias("audit_id"), F.col("there").alias("page_url"), "strategy", F.expr("cast(s div (2 * m) as int)").alias("lcp_ms"),
        F.expr("cast((s div (500 * m)) / 100.0D + 0.005D as float)").alias("cls"), F.expr("cast((least * 150) div 100 as int)").alias("inp_ms"), F.col("flags").alias("usability_flags"),
    )
