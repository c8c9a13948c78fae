"""Pages and their parts from raw HTML.

One Arrow-batched pass parses each page into a struct; everything after it (links,
images, alternates as tables, hashes, flags) is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.urls import classify_link, normalize_url, resolve_url
from ..schemas import PAGES

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HEAD_ONLY = frozenset(("head", "title"))
_SILENT = frozenset(("script", "style"))

_LINK = "href string, anchor_text string, type string, rel array<string>"
_IMAGE = "src string, alt string, title string"
_ALTERNATE = "lang string, href string"
#: What one page gives.
EXTRACTED = (
    "title array<string>, meta_description array<string>, h1 array<string>, h2 array<string>, canonical_url string, is_self_canonical boolean, meta_robots string, "
    f"rel_next string, rel_prev string, body_text string, links array<struct<{_LINK.replace(' string', ':string').replace(' array', ':array')}>>, "
    f"images array<struct<{_IMAGE.replace(' string', ':string')}>>, alternates array<struct<{_ALTERNATE.replace(' string', ':string')}>>"
)


class _Page(HTMLParser):
    """Collects a page's parts; text is gathered for every element of interest that is open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str]]] = []
        self.silent: str | None = None
        self.in_head = False
        self.texts: dict[str, list[list[str]]] = {t: [] for t in ("title", "h1", "h2")}
        self.metas: list[tuple[str, str]] = []
        self.rels: list[tuple[list[str], str | None, str | None]] = []
        self.anchors: list[tuple[dict, list[str]]] = []
        self.images: list[dict] = []
        self.body: list[str] = []

    def handle_starttag(self, tag, attrs):
        given = {}
        for k, v in attrs:
            given.setdefault(k, "" if v is None else v)
        if tag == "head":
            self.in_head = True
        elif tag == "body" or (self.in_head and tag not in ("title", "meta", "link", "script", "style", "base", "noscript", "template")):
            self.in_head = False
        if tag in _SILENT:
            self.silent = tag
        elif tag in self.texts:
            self.open.append((tag, []))
            self.texts[tag].append(self.open[-1][1])
        elif tag == "a" and "href" in given:
            self.handle_endtag("a")
            self.open.append(("a", []))
            self.anchors.append((given, self.open[-1][1]))
        elif tag == "meta":
            self.metas.append((given.get("name", "").strip().lower(), given.get("content", "").strip()))
        elif tag == "link":
            self.rels.append((given.get("rel", "").lower().split(), given.get("href"), given.get("hreflang")))
        elif tag == "img":
            self.images.append(given)

    def handle_endtag(self, tag):
        if tag == self.silent:
            self.silent = None
        elif tag == "head":
            self.in_head = False
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i]
                break

    def handle_data(self, data):
        if self.silent:
            return
        for _, parts in self.open:
            parts.append(data)
        if not self.in_head and not any(tag == "title" for tag, _ in self.open):
            self.body.append(data)


def _squeeze(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def extract_page(html: str, base: str) -> dict:
    """Everything that the page struct holds; missing parts are empty lists or None."""
    page = _Page()
    page.feed(html)
    page.close()

    def first_rel(name: str) -> str | None:
        return next((u for rel, href, _ in page.rels if name in rel and href is not None and (u := resolve_url(base, href))), None)

    canonical = first_rel("canonical")
    self_canonical = None
    if canonical is not None:
        try:
            self_canonical = normalize_url(canonical) == normalize_url(base)
        except (ValueError, UnicodeError):
            self_canonical = False
    links = []
    for given, parts in page.anchors:
        if href := resolve_url(base, given["href"]):
            links.append({"href": href, "anchor_text": _squeeze(parts) or None, "type": classify_link(base, href), "rel": list(dict.fromkeys(given.get("rel", "").lower().split()))})
    images = []
    for given in page.images:
        source = given.get("src", given.get("data-src"))
        if source and source.strip() and (src := resolve_url(base, source)):
            images.append({"src": src, "alt": given.get("alt"), "title": given.get("title")})
    alternates = [{"lang": lang.strip(), "href": u} for rel, href, lang in page.rels if "alternate" in rel and lang and lang.strip() and href is not None and (u := resolve_url(base, href))]
    return {
        "title": [t for p in page.texts["title"] if (t := "".join(p).strip())],
        "meta_description": [c for n, c in page.metas if n == "description" and c],
        "h1": [t for p in page.texts["h1"] if (t := _squeeze(p))],
        "h2": [t for p in page.texts["h2"] if (t := _squeeze(p))],
        "canonical_url": canonical,
        "is_self_canonical": self_canonical,
        "meta_robots": next((c for n, c in page.metas if n == "robots" and c), None),
        "rel_next": first_rel("next"),
        "rel_prev": first_rel("prev"),
        "body_text": _squeeze(page.body) or None,
        "links": links,
        "images": images,
        "alternates": alternates,
    }


def extract(crawl: DataFrame) -> DataFrame:
    """Crawled rows (audit_id, url, html; optional final_url, status_code, headers, depth, crawl_source, fetched) with the page struct's columns added."""
    have = set(crawl.columns)
    optional = {"final_url": "string", "status_code": "int", "depth": "int", "crawl_source": "string", "headers": "map<string,array<string>>", "fetched": "long"}
    rows = crawl.select("audit_id", "url", "html", *[F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in optional.items()])
    rows = rows.withColumn("base", tx.base_url(F.col("url"), F.col("final_url")))

    @F.pandas_udf(EXTRACTED)
    def run(pages: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for html, base in pages:
            yield pd.DataFrame([extract_page(h or "", b or "") for h, b in zip(html, base, strict=True)], columns=["title", "meta_description", "h1", "h2", "canonical_url", "is_self_canonical", "meta_robots", "rel_next", "rel_prev", "body_text", "links", "images", "alternates"])

    return rows.withColumn("x", run("html", "base")).select("*", "x.*").drop("x")


def to_pages(extracted: DataFrame) -> DataFrame:
    """Rows of the pages table: one per URL, the first fetched."""
    headers = F.col("headers")
    text = F.col("body_text")
    rows = extracted.select(
        "audit_id", F.col("url"), "final_url", "status_code", tx.status_class(F.col("status_code")).alias("status_class"),
        tx.redirect_chain(F.col("url"), F.col("final_url"), F.col("status_code")).alias("redirect_chain"), tx.header(headers, "content-type").alias("content_type"),
        F.lit(None).cast("int").alias("response_time_ms"), tx.content_length(tx.header(headers, "content-length"), F.col("html")).alias("content_length_bytes"),
        F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("crawl_source", F.lit("link")).alias("crawl_source"), "title", "meta_description", "h1", "h2",
        "canonical_url", "is_self_canonical", "meta_robots", tx.header(headers, "x-robots-tag").alias("x_robots_tag"), F.lit(False).alias("blocked_by_robots_txt"),
        "rel_next", "rel_prev", F.sha2(F.lower(text), 256).alias("content_hash"), F.lit(0).alias("inlink_count"), "fetched",
    )
    return keep_first(rows).select(*PAGES.fieldNames())


def keep_first(rows: DataFrame) -> DataFrame:
    """The first fetched row of every URL of an audit."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("audit_id", "url").orderBy(F.col("fetched").asc_nulls_last()))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def to_links(extracted: DataFrame) -> DataFrame:
    """One row per anchor, duplicates kept."""
    each = extracted.select("audit_id", F.col("base").alias("source_url"), F.explode("links").alias("l")).select("audit_id", "source_url", "l.*")
    return each.select("*", F.lit(None).cast("int").alias("target_status_code"), F.lit(None).cast("boolean").alias("is_redirect"), F.lit(None).cast("boolean").alias("is_broken"))


def to_images(extracted: DataFrame) -> DataFrame:
    each = extracted.select("audit_id", F.col("base").alias("page_url"), F.explode("images").alias("i")).select("audit_id", "page_url", "i.*")
    return each.withColumn("status_code", F.lit(None).cast("int"))


def to_hreflang(extracted: DataFrame) -> DataFrame:
    each = extracted.select("audit_id", F.col("base").alias("page_url"), F.explode("alternates").alias("a")).select("audit_id", "page_url", "a.*")
    return each.withColumn("is_reciprocal", F.lit(None).cast("boolean"))


def titles(html):
    """Titles as an expression, for well-formed pages: trimmed, white space kept, empty ones dropped."""
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit("(?is)<title[^>]*>(.*?)</title>"), F.lit(1)), lambda t: F.trim(t)), lambda t: t != "")


def headings(html, tag: str = "h1"):
    """Headings as an expression: inner tags dropped, white space collapsed, empty ones dropped."""
    found = F.regexp_extract_all(html, F.lit(f"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.filter(F.transform(found, lambda t: tx.collapse(F.regexp_replace(t, "<[^>]+>", ""))), lambda t: t != "")
