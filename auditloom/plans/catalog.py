"""Queries over the test data and their SQL: one per check, enrichment, sampling, read and report operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import text as tx
from ..functions import urls
from ..operators import attempts, enrich, frontier, perf
from ..operators.checks import REGISTRY
from ..ship import ship
from ..sources import demo, html, psi, shared, versions
from ..sources.tables import Tables, exists
from . import derived, engine, oracle, paged, read_api, report, texts

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(run: Query) -> Query:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return run(spark, sf_dir)

        _QUERIES[name] = query
        if sql is not None:
            _SQL[name] = sql
        return run

    return add


_KEPT: dict[tuple[str, str, str], Tables | DataFrame] = {}


def _kept(what: str, spark: SparkSession, sf_dir: str, make: Callable[[], Tables | DataFrame]):
    """Derived tables are shared by some eighty queries: persisted once per session and folder (lost blocks are recomputed)."""
    key = (what, spark.sparkContext.applicationId, sf_dir)
    if key not in _KEPT:
        made = make()
        _KEPT[key] = Tables(**{n: getattr(made, n).persist() for n in made.__dataclass_fields__}) if isinstance(made, Tables) else made.persist()
    return _KEPT[key]


def forget() -> None:
    """Drop all shared derived tables, so that the next query makes its own."""
    for kept in _KEPT.values():
        for df in [getattr(kept, n) for n in kept.__dataclass_fields__] if isinstance(kept, Tables) else [kept]:
            df.unpersist()
    _KEPT.clear()


def _tables(spark: SparkSession, sf_dir: str) -> Tables:
    def make() -> Tables:
        raw = _kept("raw", spark, sf_dir, lambda: demo.demo_tables(spark, sf_dir))
        return enrich.enrich(raw)

    return _kept("enriched", spark, sf_dir, make)


def flat(df: DataFrame) -> DataFrame:
    """Arrays as text joined by '|' (of structs: their URLs), floats as doubles."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            c = F.transform(c, lambda x: x["url"]) if isinstance(f.dataType.elementType, T.StructType) else c
            c = F.array_join(c, "|")
        elif isinstance(f.dataType, T.FloatType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept("findings", spark, sf_dir, lambda: engine.run_checks(_tables(spark, sf_dir)).findings)


def _add_checks() -> None:
    for check in REGISTRY.values():
        name = "check_" + check.id.replace(".", "_").replace("-", "_")
        _query(name, oracle.check_sql(check.id))(lambda s, d, c=check: flat(c.plan(_tables(s, d)).drop("audit_id")))


_add_checks()
_SEVERITY = {c.id: c.severity for c in REGISTRY.values()}
_F = oracle.findings_cte(_SEVERITY)
_PAGES = r"""with p as (select regexp_replace(url, '#.*$', '') as url,
  replace(replace(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '&quot;', '"'), '&amp;', '&') as title,
  replace(replace(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')), '&quot;', '"'), '&amp;', '&') as h1, page_id, url as raw_url, html from pages)
"""


# --- real pages ------------------------------------------------------------------


def _real(spark: SparkSession, sf_dir: str) -> Tables:
    pages = demo.real_pages(spark, sf_dir)
    return Tables(pages, pages, pages, pages, pages)


@_query("real_title_duplicate", _PAGES + """select url, title, n as "duplicateCount" from (select *, count(*) over (partition by title) as n from p where title <> '') where n > 1""")
def _(s, d):
    return REGISTRY["meta.title.duplicate"].plan(_real(s, d)).drop("audit_id")


@_query("real_title_template", _PAGES + "select url, title, length(title) as length, case when length(title) < 30 then 'too-short' else 'too-long' end as recommendation from p where length(title) not between 30 and 60")
def _(s, d):
    return REGISTRY["meta.title.template"].plan(_real(s, d)).drop("audit_id")


@_query("real_h1_duplicate", _PAGES + """select url, h1, n as "duplicateCount" from (select *, count(*) over (partition by h1) as n from p where h1 <> '') where n > 1""")
def _(s, d):
    return REGISTRY["meta.h1.duplicate"].plan(_real(s, d)).drop("audit_id")


@_query("real_main_mirror", _PAGES + r"""select url, k as "variantKey", array_to_string(v, '|') as variants, len(v)::bigint as "mirrorCount" from (select url, regexp_replace(regexp_replace(url, '^https?://', ''), '^www\.', '') as k from p)
  join (select regexp_replace(regexp_replace(url, '^https?://', ''), '^www\.', '') as k, list_sort(list(distinct regexp_extract(url, '^(https?://[^/]+)', 1))) as v from p group by 1 having len(v) > 1) using (k)""")
def _(s, d):
    return flat(REGISTRY["mirror.main-mirror"].plan(_real(s, d)).drop("audit_id"))


# --- extraction and functions ------------------------------------------------------


def _crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select(F.lit("real").alias("audit_id"), urls.normalized("url").alias("url"), "html", F.lit(200).alias("status_code"), F.col("page_id").alias("fetched"))


@_query("extract_pages", _PAGES.replace(", html from pages)", ", html from pages)") + r""" select raw_url, title, h1 from p""")
def _(s, d):
    pages = s.read.parquet(f"{d}/pages.parquet").select(F.lit("real").alias("audit_id"), "url", "html")
    found = html.extract(pages)
    return found.select(F.col("url").alias("raw_url"), F.get("title", 0).alias("title"), F.get("h1", 0).alias("h1"))


for _name, (_run, _sql) in derived.QUERIES.items():
    _query(_name, _sql)(_run)


@_query("extract_links", r"""select regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' as origin, count(*) as links from (select url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) from pages) group by 1""")
def _(s, d):
    links = html.to_links(html.extract(_crawl(s, d))).where("type = 'internal'")
    return links.groupBy(F.concat(F.regexp_extract("source_url", "^(https?://[^/?#]+)", 1), F.lit("/")).alias("origin")).agg(F.count(F.lit(1)).alias("links"))


@_query("html_title_expression", _PAGES + "select page_id, title from p")
def _(s, d):
    pages = s.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", tx.decode_basic(F.get(html.titles(F.col("html")), 0)).alias("title"))


@_query("text_collapse_hash", r"select doc_id, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) as content_hash from documents")
def _(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(F.lower(tx.collapse(F.col("text"))), 256).alias("content_hash"))


@_query("spa_shell_pages", r"""select page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))) <= 200
  and (regexp_matches(html, '(?i)id=["''](app|root|__next)["'']') or contains(lower(html), 'data-reactroot')) as shell from pages""")
def _(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", tx.spa_shell(F.col("html")).alias("shell"))


@_query("url_without_fragment", "select page_id, regexp_replace(url, '#.*$', '') as url from pages")
def _(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", urls.without_fragment(F.col("url")).alias("url"))


@_query("url_normalize_real", r"""select page_id, regexp_replace(url, '#.*$', '') as url from pages""")
def _(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", urls.normalized("url").alias("url"))


@_query("url_resolve_root", """select page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/a/b' as href from pages""")
def _(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", urls.resolved("url", F.lit("/a/b")).alias("href"))


@_query("url_classify", """select page_id, case when lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) = lower(regexp_extract(lag(url) over (order by page_id), '^https?://([^/?#:]+)', 1)) then 'internal' else 'external' end as type from pages""")
def _(s, d):
    pages = s.read.parquet(f"{d}/pages.parquet")
    before = pages.select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("before"))
    return pages.join(before, "page_id", "left").select("page_id", urls.link_type(F.col("url"), F.col("before")).alias("type"))


@_query("url_variants", r"""select distinct s || w || regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') || '/' as variant from pages, (select unnest(['http://', 'https://']) as s), (select unnest(['', 'www.']) as w)""")
def _(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select(F.explode(urls.variants(F.col("url"))).alias("variant")).distinct()


@_query("url_unsafe_real", "select page_id, length(url) > 2048 as unsafe from pages")
def _(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", urls.unsafe("url").alias("unsafe"))


@_query("url_strip_scheme", "select page_id, regexp_replace(url, '^https?://', '') as bare from pages")
def _(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", urls.strip_scheme(F.col("url")).alias("bare"))


_KEY = r"""'/' || array_to_string([case when regexp_full_match(x, '\d+') or (length(x) >= 8 and regexp_full_match(x, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9a-fA-F]{12,}|[0-9a-fA-F]*[0-9][0-9a-fA-F]*')) then ':id' else x end
  for x in string_split(regexp_replace(regexp_replace(%s, '^[a-zA-Z]+://[^/?#]*', ''), '[?#].*$', ''), '/') if x <> ''], '/')"""


@_query("url_template_key", f"select page_id, {_KEY % 'url'} as template_key from pages")
def _(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", urls.template_key(F.col("url")).alias("template_key"))


# --- enrichment ----------------------------------------------------------------------


@_query("enrich_link_targets", oracle.VIEWS + "select source_url, href, type, target_status_code, is_redirect, is_broken from links")
def _(s, d):
    return _tables(s, d).links.select("source_url", "href", "type", "target_status_code", "is_redirect", "is_broken")


@_query("enrich_inlinks", oracle.VIEWS + "select url, inlink_count::int as inlink_count from p")
def _(s, d):
    return _tables(s, d).pages.select("url", "inlink_count")


@_query("enrich_reciprocity", oracle.VIEWS + "select page_url, lang, href, is_reciprocal from hl")
def _(s, d):
    return _tables(s, d).hreflang.select("page_url", "lang", "href", "is_reciprocal")


@_query("enrich_image_status", oracle.VIEWS + "select page_url, src, alt, status_code from im")
def _(s, d):
    return _tables(s, d).images.select("page_url", "src", "alt", "status_code")


@_query("enrich_summary", oracle.VIEWS + """select count(target_status_code) as links_resolved, count_if(is_redirect) as links_redirect, count_if(is_broken) as links_broken,
  (select count_if(inlink_count > 0) from p) as pages_with_inlinks, (select count_if(len(hops) > 1) from p) as redirect_chain_pages, (select count_if(len(hops) > 1 and len(hops) > len(list_distinct(hops))) from p) as redirect_loop_pages,
  (select count(status_code) from im) as images_resolved, (select count_if(is_reciprocal) from hl) as hreflang_reciprocal from links""")
def _(s, d):
    return enrich.summary(_tables(s, d))


@_query("verify_candidates", oracle.VIEWS + "select href from (select distinct href from links where is_broken order by href limit 501) where regexp_matches(href, '^https?://') order by href limit 500")
def _(s, d):
    return enrich.verify_candidates(_tables(s, d).links)


_VERIFIED = "select href, case length(href) % 4 when 0 then 200 when 1 then 301 when 2 then 503 end as status from (select distinct href from links where is_broken)"


@_query("verify_merge", oracle.VIEWS + f"""select source_url, l.href, case when status is not null then status else target_status_code end as target_status_code,
  case when status between 200 and 399 then status >= 300 else is_redirect end as is_redirect, case when status between 200 and 399 then false else is_broken end as is_broken from links l left join ({_VERIFIED}) v on l.href = v.href""")
def _(s, d):
    links = _tables(s, d).links
    status = F.when(F.length("href") % 4 == 0, 200).when(F.length("href") % 4 == 1, 301).when(F.length("href") % 4 == 2, 503)
    results = links.where("is_broken").select("href").distinct().withColumn("status", status)
    return enrich.merge_verified(links, results).select("source_url", "href", "target_status_code", "is_redirect", "is_broken")


# --- crawl rows ------------------------------------------------------------------------


_CRAWLED = "(select page_id, regexp_replace(url, '#.*$', '') as url, html, case page_id % 7 when 0 then 301 when 1 then 404 when 2 then 503 when 3 then 100 else 200 end as code, page_id % 3 = 0 as moved from pages)"


def _crawled(s: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id") % 7
    code = F.when(i == 0, 301).when(i == 1, 404).when(i == 2, 503).when(i == 3, 100).otherwise(200)
    pages = s.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", urls.without_fragment(F.col("url")).alias("url"), "html", code.alias("code"), (F.col("page_id") % 3 == 0).alias("moved"))


@_query("crawl_status_class", f"select page_id, case when code between 200 and 599 then (code // 100)::varchar || 'xx' end as status_class from {_CRAWLED}")
def _(s, d):
    return _crawled(s, d).select("page_id", tx.status_class(F.col("code")).alias("status_class"))


@_query("crawl_keep_first", f"select page_id, url from {_CRAWLED} qualify row_number() over (partition by url order by page_id) = 1")
def _(s, d):
    rows = _crawled(s, d).select(F.lit("real").alias("audit_id"), "url", F.col("page_id").alias("fetched"))
    return html.keep_first(rows).select(F.col("fetched").alias("page_id"), "url")


@_query("crawl_redirect_chain", f"select page_id, case when moved then url || ' 301 > ' || url || 'x ' || code else '' end as chain from {_CRAWLED}")
def _(s, d):
    final = F.when(F.col("moved"), F.concat("url", F.lit("x")))
    chain = tx.redirect_chain(F.col("url"), final, F.col("code"))
    hops = F.transform(chain, lambda h: F.concat(h["url"], F.lit(" "), h["statusCode"].cast("string")))
    return _crawled(s, d).select("page_id", F.array_join(hops, " > ").alias("chain"))


@_query("crawl_content_length", f"select page_id, case when page_id % 2 = 0 then page_id else strlen(html) end::int as length from {_CRAWLED}")
def _(s, d):
    declared = F.when(F.col("page_id") % 2 == 0, F.col("page_id").cast("string")).otherwise("12x")
    return _crawled(s, d).select("page_id", tx.content_length(declared, F.col("html")).alias("length"))


@_query("crawl_base_url", f"select page_id, case when moved then url || 'x' else url end as base from {_CRAWLED}")
def _(s, d):
    final = F.when(F.col("moved"), F.concat("url", F.lit("x"))).otherwise(" ")
    return _crawled(s, d).select("page_id", tx.base_url(F.col("url"), final).alias("base"))


_VISITS = oracle.VIEWS + """, e as (
  select source_url, href, min(k) as at from (select u as source_url, (select s.u from src s where s.i = (7 * src.i + 3 * k) % n) as href, k from src, cnt, (select unnest(range(5)) as k) where i % 4 <> 0) group by all
), seeds as (
  select u as url, min(i) as rank from src where i = 1 group by u
), levels as (
  with recursive walk(url, depth, path) as (
    select url, 0, [rank] from seeds
    union
    select e.href, w.depth + 1, null from (select distinct url, depth from walk) w join e on e.source_url = w.url where w.depth < 60
  ) select url, min(depth) as depth from walk group by url
)
"""


@_query("crawl_depths", _VISITS + "select url, depth::int as depth from levels")
def _(s, d):
    """How deep a crawl from the second page (the first one has no internal links) meets each page of the derived link graph, without a budget."""
    return frontier.visits(*_site(s, d), most=1 << 62).select("url", "depth")


def _site(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = demo.raw(s, d)
    links = _tables(s, d).links.where("href not like '%uncrawled%'").withColumn("at", F.lit(0))
    return frontier.site_links(links), pages.where("i = 1").select(F.col("u").alias("url"), F.col("i").alias("rank"), F.lit("link").alias("crawl_source"))


# --- sampling and performance ------------------------------------------------------------


_SAMPLES = oracle.VIEWS + f""", keyed as (select url, inlink_count, depth, {_KEY % 'url'} as template_key from ok),
reps as (select template_key, arg_min(url, {{'i': -inlink_count, 'd': depth, 'u': url}}) as url, count(*) as cluster_size from keyed group by 1)
"""


@_query("perf_candidates", oracle.VIEWS + "select url, inlink_count::int as inlink_count, depth from ok")
def _(s, d):
    return perf.candidates(_tables(s, d).pages)


@_query("perf_representatives", _SAMPLES + "select * from reps")
def _(s, d):
    return perf.representatives(perf.candidates(_tables(s, d).pages))


@_query("perf_samples", _SAMPLES + "select * from reps order by cluster_size desc, template_key limit 20")
def _(s, d):
    return perf.samples(perf.candidates(_tables(s, d).pages))


@_query("perf_uncached", _SAMPLES + """select x.url, x.strategy from (select url, unnest(['mobile', 'desktop']) as strategy from (select * from reps order by cluster_size desc, template_key limit 20)) x
  where not exists (select 1 from perf q where q.page_url = x.url and q.strategy = x.strategy)""")
def _(s, d):
    t = _tables(s, d)
    return perf.uncached(perf.pairs(perf.samples(perf.candidates(t.pages))), t.performance)


@_query("perf_psi_parse")
def _(s, d):
    """Metrics of PageSpeed JSON made from events."""
    events = s.read.parquet(f"{d}/events.parquet")
    value = F.floor("value").cast("long")
    body = F.to_json(F.struct(
        F.struct(F.create_map(F.lit("INTERACTION_TO_NEXT_PAINT"), F.struct(value.alias("percentile"))).alias("metrics")).alias("loadingExperience"),
        F.struct(F.create_map(F.lit("performance"), F.struct((value % 100 / 100).alias("score"), F.array(F.struct(F.lit("speed-index").alias("id"))).alias("auditRefs"))).alias("categories"),
                 F.create_map(F.lit("speed-index"), F.struct((value % 10 / 10).alias("score"), (value * 10).alias("numericValue"))).alias("audits")).alias("lighthouseResult"),
    ))
    parsed = psi.parse(events.select("event_id", body.alias("psi_raw")))
    return flat(parsed.drop("psi_raw"))


_SQL["perf_psi_parse"] = """with v as (select event_id, floor(value)::bigint as v from events)
select event_id, null::int as lcp_ms, null::double as cls, v::int as inp_ms, (v % 100)::double as performance_score, null::int as fcp_ms, null::int as tbt_ms, (v * 10)::int as speed_index_ms,
  case when v % 10 < 9 then 'speed-index' else '' end as usability_flags from v"""


def _bodies(s: SparkSession, d: str) -> DataFrame:
    """PageSpeed replies made from events: field data for even ids, lab data for all, some cut short, some errors, some empty."""
    i, v = F.col("event_id"), F.floor("value").cast("long")
    number = lambda x: F.struct(x.cast("double").alias("numericValue"), F.lit(1.0).alias("score"))
    field = F.create_map(F.lit("LARGEST_CONTENTFUL_PAINT_MS"), F.struct((v * 10).alias("percentile")), F.lit("CUMULATIVE_LAYOUT_SHIFT_SCORE"), F.struct((v % 50).alias("percentile")), F.lit("INTERACTION_TO_NEXT_PAINT"), F.struct((v + 1).alias("percentile")))
    audits = F.create_map(*[x for name, metric in (
        ("largest-contentful-paint", number(v * 7 + 0.4)), ("cumulative-layout-shift", number(v % 8 / 16)), ("first-contentful-paint", number(v * 3 + 0.6)), ("total-blocking-time", number(v * 2)), ("speed-index", number(v * 5 + 0.25)),
        ("tap-targets", F.struct(F.lit(None).cast("double").alias("numericValue"), (v % 3 / 2).alias("score"))), ("font-size", F.struct(F.lit(None).cast("double").alias("numericValue"), (v % 2).cast("double").alias("score"))),
    ) for x in (F.lit(name), metric)])
    refs = lambda *names: F.array(*[F.struct(F.lit(n).alias("id")) for n in names])
    categories = F.create_map(F.lit("performance"), F.struct((v % 100 / 100).alias("score"), refs("tap-targets", "speed-index").alias("auditRefs")), F.lit("seo"), F.struct(F.lit(1.0).alias("score"), refs("font-size", "absent").alias("auditRefs")))
    lab = F.struct(categories.alias("categories"), audits.alias("audits")).alias("lighthouseResult")
    whole = F.when(i % 2 == 0, F.to_json(F.struct(F.struct(field.alias("metrics")).alias("loadingExperience"), lab))).otherwise(F.to_json(F.struct(lab)))
    cut = F.substring(whole, 1, 40)
    body = F.when(i % 11 == 1, cut).when(i % 11 == 2, F.lit('{"error":{"code":429,"message":"quota"}}')).when(i % 11 == 3, " ").when(i % 11 == 4, "{}").otherwise(whole)
    return s.read.parquet(f"{d}/events.parquet").select("event_id", body.alias("psi_raw"))


@_query("perf_psi_metrics", """with v as (select event_id as i, floor(value)::bigint as v from events where event_id % 11 not in (1, 2, 3, 4))
select i as event_id, (case when i % 2 = 0 then v * 10 else v * 7 end)::int as lcp_ms, (case when i % 2 = 0 then round((v % 50) / 100, 3) else round((v % 8) / 16 + 1e-9, 3) end)::float::double as cls, (case when i % 2 = 0 then v + 1 end)::int as inp_ms, (v % 100)::double as performance_score,
  (v * 3 + 1)::int as fcp_ms, (v * 2)::int as tbt_ms, (v * 5)::int as speed_index_ms, array_to_string(list_filter([case when v % 2 = 0 then 'font-size' end, case when (v % 3) < 2 then 'tap-targets' end], lambda x: x is not null), '|') as usability_flags from v""")
def _(s, d):
    """All eight metrics and the flags, from field data where there is some and lab data elsewhere."""
    kept, _rejected = psi.read(_bodies(s, d))
    return flat(kept.drop("psi_raw"))


@_query("perf_psi_rejected", """select c as cause, count(event_id) as n from (select unnest(['no body', 'malformed', 'error reply', 'no results']) as c, unnest([3, 1, 2, 4]) as k) left join events on event_id % 11 = k group by c""")
def _(s, d):
    return psi.rejected_by_cause(psi.read(_bodies(s, d))[1])


@_query("perf_psi_outcome", "select count(*) as requested, count(*) filter (event_id % 2 = 0) as cached, count(*) filter (event_id % 11 not in (1, 2, 3, 4)) as ok, count(*) filter (event_id % 11 in (1, 2, 3, 4)) as failed from events")
def _(s, d):
    """A run in which replies that are no results count as failed."""
    kept, rejected = psi.read(_bodies(s, d).select(F.col("event_id").cast("string").alias("url"), F.lit("mobile").alias("strategy"), "psi_raw"))
    runs = kept.select("url", "strategy", F.lit(None).cast("string").alias("error")).unionByName(rejected.select("url", "strategy", F.col("cause").alias("error")))
    wanted = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").cast("string").alias("url"), F.lit("mobile").alias("strategy"))
    return perf.outcome(runs, wanted, wanted.where("cast(url as long) % 2 = 0").select(F.col("url").alias("page_url"), "strategy"))


@_query("perf_upsert", oracle.VIEWS + "select page_url, strategy, case when strategy = 'mobile' then -1 else lcp_ms end as lcp_ms from perf")
def _(s, d):
    old = _tables(s, d).performance.select("audit_id", "page_url", "strategy", "lcp_ms")
    return perf.upsert(old, old.where("strategy = 'mobile'").withColumn("lcp_ms", F.lit(-1))).select("page_url", "strategy", "lcp_ms")


@_query("perf_outcome", oracle.VIEWS + "select count(*) as requested, count(q.page_url) as cached, (select count(*) from perf where lcp_ms <= 2500) as ok, (select count(*) from perf where lcp_ms > 2500) as failed from (select url, unnest(['mobile', 'desktop']) as strategy from ok) x left join perf q on q.page_url = x.url and q.strategy = x.strategy")
def _(s, d):
    t = _tables(s, d)
    runs = t.performance.select("page_url", "strategy", F.when(F.col("lcp_ms") > 2500, "slow").alias("error"))
    return perf.outcome(runs, perf.pairs(perf.candidates(t.pages)), t.performance)


@_query("perf_refresh", _F + "select rule_id, count(*) as n from f where rule_id not like 'perf.%' or rule_id = 'perf.lcp' group by 1")
def _(s, d):
    found = _findings(s, d)
    return perf.refresh(found, found.where("rule_id = 'perf.lcp'")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


# --- attempts -----------------------------------------------------------------------------


@_query("attempts_login_throttle", """with a as (select event_id, user_id as key, epoch(date_trunc('second', ts))::bigint as "at", event_type = 'error' as failed from events),
 r as (select *, sum(case when failed then 0 else 1 end) over (partition by key order by "at") as resets from a),
 c as (select event_id, key, "at", failed, sum(case when failed then 1 else 0 end) over (partition by key, resets order by "at" range between 86400 preceding and current row)::bigint as failures from r)
select *, failures >= 5 as locked from c""")
def _(s, d):
    events = s.read.parquet(f"{d}/events.parquet")
    rows = events.select("event_id", F.col("user_id").alias("key"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_type") == "error").alias("failed"))
    return attempts.login_failures(rows, seconds=86400)


@_query("attempts_contact_limit", """select *, hits > 5 as limited from (select event_id, event_type as key, epoch(date_trunc('second', ts))::bigint as "at", count(*) over (partition by event_type order by epoch(date_trunc('second', ts))::bigint range between 3599 preceding and current row) as hits from events)""")
def _(s, d):
    events = s.read.parquet(f"{d}/events.parquet")
    return attempts.contact_hits(events.select("event_id", F.col("event_type").alias("key"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at")), seconds=3600)


# --- findings, reads, report -------------------------------------------------------------------


@_query("findings", _F + "select rule_id, severity, url, count(*) as n from f group by all")
def _(s, d):
    return _findings(s, d).groupBy("rule_id", "severity", "url").agg(F.count(F.lit(1)).alias("n"))


@_query("findings_by_severity", _F + "select s as severity, count(url) as findings from (select unnest(['critical', 'high', 'medium', 'low', 'info']) as s) left join f on f.severity = s group by 1")
def _(s, d):
    return engine.by_severity(_findings(s, d))


@_query("findings_by_rule", _F + "select rule_id, severity, count(*) as findings from f group by all")
def _(s, d):
    return engine.by_rule(_findings(s, d))


@_query("findings_severity_shares", _F + "select s as severity, count(url) as findings, count(url) / (select count(*) from f) * 100 as percent from (select unnest(['critical', 'high', 'medium', 'low', 'info']) as s) left join f on f.severity = s group by 1")
def _(s, d):
    return engine.shares(_findings(s, d))


@_query("findings_page", _F + "select rule_id, severity, url from ranked where rule_id like 'links.broken%' order by rank, rule_id, url nulls last limit 50 offset 10")
def _(s, d):
    rows = _findings(s, d).where(F.col("rule_id").startswith("links.broken"))
    page, _total = read_api.list_findings(rows, limit=50, offset=10)
    return page.select("rule_id", "severity", "url")


@_query("findings_deep_page", _F + "select rule_id, severity, url from ranked where severity = 'medium' order by rank, rule_id, url nulls last limit 100 offset (select count(*) // 2 from ranked where severity = 'medium')")
def _(s, d):
    """A page from the middle of all medium findings, read from the files that hold it."""
    found = _findings(s, d)
    folder = f"{shared.folder(s)}/auditloom-paged-{uuid.uuid4().hex}"
    paged.store(found, folder, file_rows=1000)
    pages = paged.Pages(s, folder)
    _first, total = pages.page(severity="medium")
    page, _total = pages.page(severity="medium", limit=100, offset=total // 2)
    return page.select("rule_id", "severity", "url")


@_query("findings_of_rule_total", _F + "select count(*) as total from f where rule_id = 'dupe.content'")
def _(s, d):
    return read_api.matching(_findings(s, d), rule_id="dupe.content").agg(F.count(F.lit(1)).alias("total"))


_TEXTS = ", ".join("('{}', '{}', '{}')".format(c.id, c.id.split(".")[0], c.description.replace("'", "''")) for c in REGISTRY.values())


@_query("findings_described", _F + f"""select rule_id, upper(left(t, 1)) || substr(t, 2) as title, family, description, count(*) as n
  from (select *, lower(regexp_replace(replace(rule_id, '.', ' '), '[_-]+', ' ', 'g')) as t from f) join (values {_TEXTS}) x(rule_id, family, description) using (rule_id) group by all""")
def _(s, d):
    return texts.described(_findings(s, d), texts.english(s)).groupBy("rule_id", "title", "family", "description").agg(F.count(F.lit(1)).alias("n"))


@_query("findings_translated", _F + f"""select rule_id, case rule_id when 'dupe.content' then 'Doppelter Inhalt' else upper(left(t, 1)) || substr(t, 2) end as title, case rule_id when 'perf.lcp' then 'Tempo' else family end as family,
  case rule_id when 'dupe.content' then 'Seiten mit gleichem Inhalt' else description end as description, count(*) as n
  from (select *, lower(regexp_replace(replace(rule_id, '.', ' '), '[_-]+', ' ', 'g')) as t from f) join (values {_TEXTS}) x(rule_id, family, description) using (rule_id) group by all""")
def _(s, d):
    """Texts of another language over the registry's own, wherever it has them."""
    overlay = s.createDataFrame([("dupe.content", "Doppelter Inhalt", None, "Seiten mit gleichem Inhalt"), ("perf.lcp", None, "Tempo", None), ("own.unknown", "x", "y", "z")], texts.TEXTS)
    found = texts.described(_findings(s, d), texts.translated(texts.english(s), overlay))
    return found.groupBy("rule_id", "title", "family", "description").agg(F.count(F.lit(1)).alias("n"))


@_query("findings_first_details", _F.split(", f as (")[0] + """ select url, 'Target status code: ' || coalesce(target_status_code::varchar, 'null') as line from (select distinct source_url as url, href, target_status_code from links where type = 'internal' and is_broken)""")
def _(s, d):
    found = engine.of_check(REGISTRY["links.broken-internal"], _tables(s, d))
    return found.select("url", F.element_at(F.split(tx.first_details(F.col("detail")), " · "), 2).alias("line"))


@_query("report_section_summary")
def _(s, d):
    return report.section_summary(_findings(s, d))


_SQL["report_section_summary"] = (
    _F + ", sec(place, section, rule_id) as (values " + ", ".join(f"({i}, '{x.name}', '{r}')" for i, x in enumerate(report.SHEETS) for r in x.rules) + ") "
    "select place::int as place, section, count(rank) as findings, case min(rank) when 0 then 'critical' when 1 then 'high' when 2 then 'medium' when 3 then 'low' when 4 then 'info' end as dominant from sec left join ranked using (rule_id) group by 1, 2"
)


_SQL["report_sheet_rows"] = (
    _F + ", sec(place, rule_id) as (values " + ", ".join(f"({i}, '{r}')" for i, x in enumerate(report.SHEETS) for r in x.rules) + ") select place::int as section, count(*)::bigint as rows from sec join f using (rule_id) group by 1"
)


@_query("report_sheet_rows")
def _(s, d):
    """Rows of each sheet of the workbook, as counted in the parts that tasks write."""
    parts = report.sheet_parts(_findings(s, d))
    return parts.groupBy("section").agg((F.max("last") - 1).alias("rows"))


def _sheet(name: str) -> Query:
    sheet = next(x for x in report.SHEETS if x.name == name)
    return lambda s, d: sheet.rows(engine.run_checks(_tables(s, d), {r: REGISTRY[r] for r in sheet.rules}).findings)


def _advice(words: str) -> str:
    return "'" + '{"recommendation":"' + words + '"}' + "' as details"


def _element_sheet(name: str, column: str, key: str, severities: tuple[str, str, str], advice: tuple[str, str, str]) -> str:
    missing, duplicate, multiple = (oracle.CHECKS[f"meta.{name}.{k}"] for k in ("missing", "duplicate", "multiple"))
    return oracle.VIEWS + f"""select '{severities[0]}' as severity, url, 'missing' as issue, null::varchar as {key}, null::double as count, {_advice(advice[0])} from ({missing})
      union all select '{severities[1]}', url, 'duplicate', nullif({key}, ''), "duplicateCount"::double, {_advice(advice[1])} from ({duplicate})
      union all select '{severities[2]}', m.url, 'multiple', array_to_string({column}, ', '), m.count::double, {_advice(advice[2])} from ({multiple}) m join ok using (url)"""


_SHEET_SQL = {
    "Broken Links": oracle.VIEWS + """select case type when 'internal' then 'critical' else 'medium' end as severity, source_url as url, href, target_status_code::double as "targetStatusCode", type as "linkType", '{"recommendation":"Remove or fix link"}' as details
      from (select distinct source_url, href, target_status_code, type from links where is_broken)""",
    "Duplicate Pages": oracle.VIEWS + f"""select 'high' as severity, url, "contentHash", "duplicateCount"::double as "duplicateCount", '{{"recommendation":"Canonicalize duplicates to one URL"}}' as details from ({oracle.CHECKS['dupe.content']})""",
    "External Links": oracle.VIEWS + """select distinct 'low' as severity, source_url as url, href, nullif(array_to_string(rel, ', '), '') as rel, null::varchar as details from links where type = 'external' and not list_has_any(rel, ['nofollow', 'sponsored', 'ugc'])""",
    "Hreflang": oracle.VIEWS + f"""select 'medium' as severity, url, lang, href, replace(issue, ',', ', ') as issue, '{{"recommendation":"Add reciprocal return tags and valid BCP-47 lang codes"}}' as details from ({oracle.CHECKS['i18n.hreflang']})""",
    "Pagination": oracle.VIEWS + f"""select 'medium' as severity, url, "relNext", issue, '{{"recommendation":"Fix rel=next/prev reciprocity across the series"}}' as details from ({oracle.CHECKS['pagination.rel']})""",
    "URL Heuristics": oracle.VIEWS + f"""select 'low' as severity, url, replace(issues, '|', ', ') as issues, '{{"recommendation":"Use lowercase, hyphenated, short, param-free URLs"}}' as details from ({oracle.CHECKS['index.url-heuristics']})""",
}
_SHEET_SQL |= {
    "Titles": _element_sheet("title", "title", "title", ("high", "medium", "medium"), ("Add a unique <title>", "Make the title unique per page", "Keep a single <title>")),
    "Descriptions": _element_sheet("description", "meta_description", "description", ("medium", "low", "low"), ("Add a meta description", "Make the description unique per page", "Keep a single meta description")),
    "H1": _element_sheet("h1", "h1", "h1", ("high", "low", "medium"), ("Add a single <h1>", "Make the H1 unique per page", "Keep a single <h1>")),
    "Redirects": oracle.VIEWS + f"""select 'high' as severity, url, href, "targetStatusCode"::double as "targetStatusCode", null::double as hops, null::boolean as "isLoop", 'Point link to final URL (avoid the 3xx hop)' as recommendation, null::varchar as details from ({oracle.CHECKS['links.internal-redirect']})
      union all select 'high', url, null, null, hops::double, "isLoop", 'Collapse the redirect chain; link directly to the final URL', null from ({oracle.CHECKS['links.redirect-chain']})""",
    "Indexation": oracle.VIEWS + f"""select 'high' as severity, url, issue, "canonicalUrl", null::varchar as reason, {_advice("Set a self-referential canonical")} from ({oracle.CHECKS['index.canonical']})
      union all select 'high', url, 'noindex/blocked', null, replace(reason, '|', ', '), {_advice("Remove the noindex/robots block if the page should rank")} from ({oracle.CHECKS['index.robots']})""",
    "Images": oracle.VIEWS + f"""select 'low' as severity, url, src, "altState" as issue, null::double as "statusCode", {_advice("Add descriptive alt text")} from ({oracle.CHECKS['image.alt-title']})
      union all select 'medium', url, src, 'broken (' || "statusCode" || ')', "statusCode"::double, {_advice("Fix or remove the broken image")} from ({oracle.CHECKS['image.broken']})""",
    "Mirrors": oracle.VIEWS + f"""select 'high' as severity, url, 'main-mirror' as issue, replace(variants, '|', ', ') as variant, "mirrorCount"::double as "mirrorCount", {_advice("Redirect mirrors to one canonical origin")} from ({oracle.CHECKS['mirror.main-mirror']})
      union all select 'medium', url, 'trailing-slash', "slashUrl", null, {_advice("Redirect to a single trailing-slash form")} from ({oracle.CHECKS['mirror.trailing-slash']})""",
    "Performance": oracle.VIEWS + """, metrics as (select page_url as url, strategy, lcp_ms, cls::varchar::double as shown, cls::double as exact, inp_ms, nullif(array_to_string(flags, ', '), '') as flags from perf)
      select 'high' as severity, url, strategy, lcp_ms::double as "lcpMs", null::double as cls, null::double as "inpMs", null::varchar as flags, '{"metric":"lcp"}' as details from metrics where lcp_ms > 2500
      union all select 'high', url, strategy, null, shown, inp_ms::double, nullif(concat_ws(', ', case when exact > 0.1 then 'cls' end, case when inp_ms > 200 then 'inp' end), ''), '{"metric":"cls-inp"}' from metrics where exact > 0.1 or inp_ms > 200
      union all select 'medium', url, strategy, null, null, null, flags, '{"metric":"psi-usability"}' from metrics where flags is not null
      union all select 'high', url, strategy, null, null, null, flags, '{"metric":"mobile-indexing"}' from metrics where flags is not null and strategy = 'mobile'""",
    "Meta Templates": oracle.VIEWS + " union all ".join(f"select 'info' as severity, url, '{n}' as element, nullif({k}, '') as value, length::double as length, recommendation, null::varchar as details from ({oracle.CHECKS[f'meta.{n}.template']})" for n, k in (("title", "title"), ("description", "description"), ("h1", "h1"))),
}
for _s in report.SHEETS:
    _query("report_" + _s.name.lower().replace(" ", "_"), _SHEET_SQL.get(_s.name))(_sheet(_s.name))


@_query("audits_side_by_side", """with l as (select page_id, len(regexp_extract_all(html, '<a href="[^"]*">')) as n, regexp_replace(url, '#.*$', '') as u from pages)
select * from (values ('one', (select count(distinct u) from l), (select sum(n + 1)::bigint from l), true), ('two', (select count(distinct u) from l), 0, false)) v(audit_id, pages, links, has_links) order by 1""")
def _(s, d):
    """Two audits of all pages in one store; the second is crawled again and has lost all its links."""
    store = versions.Versions(s, f"{shared.folder(s)}/auditloom-versions-{uuid.uuid4().hex}")
    for audit in ("one", "two"):
        found = html.extract(derived.dressed(s, d).withColumn("audit_id", F.lit(audit)))
        store.write(audit, {"pages": html.to_pages(found), "links": html.to_links(found)})
    store.write("two", {"links": store.read("links", schemas.LINKS, "two").where("false")})
    count = lambda name, schema: store.read(name, schema).groupBy("audit_id").agg(F.count(F.lit(1)).alias(name))
    both = count("pages", schemas.PAGES).join(count("links", schemas.LINKS), "audit_id", "left")
    there = {a: exists(store.read("links", schemas.LINKS, a)) for a in store.audits()}
    return both.select("audit_id", "pages", F.coalesce("links", F.lit(0)).alias("links"), (F.col("audit_id").isin(*[a for a, x in there.items() if x])).alias("has_links"))


@_query("audits_page")
def _(s, d):
    """The newest orders as a stand-in for the run registry: an owner's rows, one page."""
    rows = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("owner_id"), F.col("o_orderdate").alias("created_at"))
    page, _total = read_api.list_audits(rows, read_api.owned("7"), 5, 0)
    return page.select("id", "owner_id")


_SQL["audits_page"] = "select o_orderkey::varchar as id, o_custkey::varchar as owner_id from orders where o_custkey = 7 order by o_orderdate desc, o_orderkey::varchar limit 5"


@_query("findings_other_sheet", _F + "select severity, rule_id, url from f where rule_id = 'dupe.content'")
def _(s, d):
    """Rules without a sheet: the content check under another name."""
    renamed = engine.of_check(REGISTRY["dupe.content"], _tables(s, d)).withColumn("rule_id", F.lit("own.content"))
    return report.other(renamed).select("severity", F.lit("dupe.content").alias("rule_id"), "url")


@_query("findings_by_rule_ordered", _F + "select row_number() over (order by case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end, count(*) desc, rule_id)::int as place, rule_id, count(*) as findings from f group by rule_id, severity")
def _(s, d):
    from pyspark.sql import Window

    ordered = engine.by_rule_ordered(_findings(s, d)).withColumn("at", F.monotonically_increasing_id())  # one row per rule
    return ordered.select(F.row_number().over(Window.orderBy("at")).alias("place"), "rule_id", "findings")


@_query("findings_in_order", _F + "select rule_id, severity, url, n::int as place from (select *, row_number() over (order by rank, rule_id, url nulls last) as n from ranked where rule_id in ('meta.title.missing', 'mirror.trailing-slash')) where n <= 60")
def _(s, d):
    from pyspark.sql import Window

    page = read_api.in_order(_findings(s, d).where(F.col("rule_id").isin("meta.title.missing", "mirror.trailing-slash"))).limit(60).withColumn("at", F.monotonically_increasing_id())
    return page.select("rule_id", "severity", "url", F.row_number().over(Window.orderBy("at")).alias("place"))


@_query("audits_reports_ready", "select count(*) filter (o_orderstatus = 'F') as reports_ready from (select * from orders order by o_orderdate desc, o_orderkey::varchar limit 50)")
def _(s, d):
    rows = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "path").alias("report_path"))
    return read_api.reports_ready(rows)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
