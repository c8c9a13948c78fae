"""Queries over what is derived from the given tables: dressed pages, odd spellings of their URLs, durations and keys from events.

Raw pages have no canonical URLs, alternates, images or robots rules; ``dressed`` puts
them into the HTML of every page by arithmetic on its id, and the SQL states from the
same arithmetic what must be found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..schemas import STAGES
from ..sources import html
from . import read_api

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _derived(name: str, sql: str):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run, sql
        return run

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, *values) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


# --- dressed pages ------------------------------------------------------------------


def dressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled rows of all pages: audit_id, url, final_url, status_code, headers, html with more tags, fetched."""
    pages = _table(spark, sf_dir, "pages")
    i, s, u = F.col("page_id"), F.col("page_id").cast("string"), urls.without_fragment(F.col("url"))

    def tag(when: Column, template: str) -> Column:
        before, _, after = template.partition("{}")
        filled = F.concat_ws("", F.lit(before), s, F.lit(after)) if "{}" in template else F.lit(template)
        return F.when(when, filled).otherwise("")

    head = F.concat(
        tag(i % 3 != 0, '<META name=" Description " content=" About {} &amp; more ">'), tag(i % 4 == 1, "<meta name='robots' content='noindex, follow'>"),
        F.when(i % 5 == 1, F.concat(F.lit('<link rel="canonical" href="'), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit('">'))).when(i % 5 == 2, F.concat(F.lit("<link href='/canon/"), s, F.lit("#x' rel=canonical>"))).otherwise(""),
        tag(i % 6 == 1, '<link rel="next nofollow" href="?page={}">'), tag(i % 6 == 2, "<link rel=PREV href=../p>"),
        tag(i % 2 == 0, '<link rel="alternate" hreflang=" de " href="/de/{}"><link rel="alternate" href="/feed">'), tag(i % 8 == 0, '<link rel="alternate" hreflang="x-default" href="//alt.example.net/{}">'),
        F.lit("</head>"),
    )
    foot = F.concat(
        tag(i % 3 == 1, "<h2> Part \n <b>{}</b> </h2><h2> </h2>"), tag(F.lit(True), '<img src="/i/{}.png" alt="Picture">'), tag(i % 2 == 1, '<img data-src="t/{}.gif" alt="">'),
        tag(i % 3 == 2, '<img src="https://CDN.example.org/{}.webp" title="T">'), tag(i % 7 == 0, '<img alt="no source"><img src="">'),
        tag(F.lit(True), '<a rel="NoFollow ugc nofollow" href="//other.example.org/{}"> Out \n there </a><a href="mailto:x@example.org">m</a><a href="#here">h</a><a href="javascript:go()">j</a>'), F.lit("<footer"),
    )
    body = F.replace(F.replace("html", F.lit("</head>"), head), F.lit("<footer"), foot)
    headers = F.create_map(F.lit("Content-TYPE"), F.array(F.lit("text/html"), F.lit("charset=utf-8")), F.lit("x-robots-tag"), F.array(F.when(i % 9 == 0, "noarchive").otherwise("")), F.lit("content-length"), F.array(F.when(i % 2 == 0, s).otherwise("many")))
    moved = F.when(i % 10 == 4, F.concat(u, F.lit("/moved"))).when(i % 10 == 5, F.lit(" "))
    return pages.select(F.lit("real").alias("audit_id"), u.alias("url"), moved.alias("final_url"), _pick(i, 200, 301, 404, 503, 100).alias("status_code"), headers.alias("headers"), body.alias("html"), i.alias("fetched"))


#: i, u (URL), b (base: where a moved page came to), o (origin), d (folder of the base) of every row of ``dressed``.
_ROWS = r"""with r as (
  select page_id as i, regexp_replace(url, '#.*$', '') as u, html, regexp_extract(url, '^(https?://[^/?#]+)', 1) as o from pages
), x as (
  select *, case when i % 10 = 4 then u || '/moved' else u end as b from r
), y as (
  select *, regexp_replace(regexp_replace(b, '\?.*$', ''), '[^/]*$', '') as d, (array[200, 301, 404, 503, 100])[i % 5 + 1] as code from x
)
"""
_FIRST = _ROWS.rstrip() + ", f as (select * from y qualify row_number() over (partition by u order by i) = 1)\n"
_TEXT = r"replace(replace(trim(regexp_replace(regexp_extract(html, '(?is)<{0}[^>]*>(.*?)</{0}>', 1), '\s+', ' ', 'g')), '&quot;', '\"'), '&amp;', '&')"


@_derived("extract_pages_table", _FIRST + """select u as url, case i % 5 when 0 then '2xx' when 1 then '3xx' when 2 then '4xx' when 3 then '5xx' end as status_class,
  case when i % 10 = 4 then u || ' 301|' || b || ' ' || code else '' end as chain, 'text/html, charset=utf-8' as content_type, case when i % 2 = 0 then i end::int as declared_length,
  case when i % 3 <> 0 then 'About ' || i || ' & more' else '' end as description, case when i % 3 = 1 then 'Part ' || i else '' end as h2,
  case i % 5 when 1 then u when 2 then o || '/canon/' || i end as canonical_url, case i % 5 when 1 then i % 10 <> 4 when 2 then false end as is_self_canonical,
  case when i % 4 = 1 then 'noindex, follow' end as meta_robots, case when i % 9 = 0 then 'noarchive' end as x_robots_tag,
  case when i % 6 = 1 then regexp_replace(b, '\\?.*$', '') || '?page=' || i end as rel_next, case when i % 6 = 2 then regexp_replace(d, '[^/]*/$', '') || 'p' end as rel_prev, true as has_hash from f""".replace("\\\\", "\\"))  # fmt: skip
def _(s, d):
    rows = dressed(s, d)
    pages = html.to_pages(html.extract(rows))
    chain = F.array_join(F.transform("redirect_chain", lambda h: F.concat(h["url"], F.lit(" "), h["statusCode"].cast("string"))), "|")
    lists = [F.array_join(c, "|").alias(n) for c, n in (("meta_description", "description"), ("h2", "h2"))]
    first = rows.groupBy("url").agg(F.min("fetched").alias("i"))
    declared = F.when(F.col("i") % 2 == 0, F.col("content_length_bytes")).alias("declared_length")
    out = pages.join(first, "url")
    return out.select("url", "status_class", chain.alias("chain"), "content_type", declared, *lists, "canonical_url", "is_self_canonical", "meta_robots", "x_robots_tag", "rel_next", "rel_prev", F.col("content_hash").isNotNull().alias("has_hash"))


_HREF = r"o || '/' || replace(url_encode(substr(l, 2)), '%2C', ',')"


@_derived("extract_links_table", _ROWS + f"""select b as source_url, {_HREF} as href, anchor as anchor_text, 'internal' as type, '' as rel from (select b, o, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) as l, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) as anchor from y)
  union all select b, regexp_extract(b, '^(https?:)', 1) || '//other.example.org/' || i, 'Out there', 'external', 'nofollow|ugc' from y""")
def _(s, d):
    return html.to_links(html.extract(dressed(s, d))).select("source_url", "href", "anchor_text", "type", F.array_join("rel", "|").alias("rel"))


@_derived("extract_images", _ROWS + """select b as page_url, o || '/i/' || i || '.png' as src, 'Picture' as alt, null::varchar as title from y
  union all select b, d || 't/' || i || '.gif', '', null from y where i % 2 = 1
  union all select b, 'https://cdn.example.org/' || i || '.webp', null, 'T' from y where i % 3 = 2""")
def _(s, d):
    return html.to_images(html.extract(dressed(s, d))).select("page_url", "src", "alt", "title")


@_derived("extract_hreflang", _ROWS + """select b as page_url, 'de' as lang, o || '/de/' || i as href from y where i % 2 = 0
  union all select b, 'x-default', regexp_extract(b, '^(https?:)', 1) || '//alt.example.net/' || i from y where i % 8 = 0""")
def _(s, d):
    return html.to_hreflang(html.extract(dressed(s, d))).select("page_url", "lang", "href")


# --- URLs -----------------------------------------------------------------------------


@_derived("url_normalize", r"""select page_id, case page_id % 4 when 3 then null when 2 then regexp_replace(url, '[?#].*$', '') || '?q=%7EA&q=%C3%A9&z=a+b' else regexp_replace(url, '#.*$', '') end as url from pages""")
def _(s, d):
    """Capitals, default ports, dot segments, unordered and unencoded parameters, fragments; some that are no URLs."""
    u, i = urls.without_fragment(F.col("url")), F.col("page_id")
    parts = [F.regexp_extract(u, r"^(https?)://([^/?#]+)(.*)$", n) for n in (1, 2, 3)]
    port = F.when(parts[0] == "http", ":80").otherwise(":443")
    turned = F.regexp_replace(parts[2], r"\?(page=\d+)&(ref=x)", "?$2&$1")
    spelled = F.concat(F.upper(parts[0]), F.lit("://"), F.upper(parts[1]), port, F.when(i % 4 == 1, "/x/..").otherwise(""), turned, F.lit("#part"))
    query = F.concat(F.regexp_replace(u, r"\?.*$", ""), F.lit("?z=a b&q=~%41&q=é"))
    given = F.when(i % 4 == 3, F.concat(parts[0], F.lit("://"))).when(i % 4 == 2, query).otherwise(spelled)
    return _table(s, d, "pages").select("page_id", given.alias("given")).select("page_id", urls.normalized("given").alias("url"))


@_derived("url_resolve", r"""with y as (select page_id, regexp_replace(url, '[?#].*$', '') as p, regexp_extract(url, '^(https?:)', 1) as scheme, regexp_extract(url, '^(https?://[^/?#]+)', 1) as o from pages), z as (select *, regexp_replace(p, '[^/]*$', '') as d from y)
select page_id, k::int as form, case k when 0 then regexp_replace(d, '[^/]+/$', '') || 'side' when 1 then d || 'below/it' when 2 then o || '/top/x' when 3 then p || '?n=1' when 4 then scheme || '//files.example.net/a' when 5 then 'https://else.example.org/X' end as href from z, (select unnest(range(10)) as k)""")
def _(s, d):
    forms = F.array(*map(F.lit, ("../side", "below/./it", "/top/gone/../x", "?n=1", "//files.example.net/a", "HTTPS://Else.Example.org:443/X#f", "mailto:me@example.org", "#part", "   ", "http://")))
    each = _table(s, d, "pages").select("page_id", "url", F.posexplode(forms).alias("form", "href"))
    return each.select("page_id", "form", urls.resolved("url", F.col("href")).alias("href"))


#: First octets of the addresses made from events, by event_id, and second ones, by user_id.
_FIRST_OCTETS, _SECOND_OCTETS = (10, 127, 172, 192, 169, 100, 0, 8), (16, 31, 32, 63, 64, 127, 128, 168, 254, 255)
#: What comes before a page's path, and whether such a URL is unsafe whatever its path.
_GUARDED = (
    ("https://example.org", False), ("HTTP://Local.Example.ORG:8080", False), ("http://notlocalhost", False), ("http://127.0.0.1@example.org", False), ("http://[2001:db8::1]", False), ("http://[fec0::1]", False), ("http://[::ffff:8.8.8.8]", False), ("http://198.51.100.1", False), ("http://240.0.0.1", False),
    ("http://localhost", True), ("https://LocalHost.:8080", True), ("http://app.localhost", True), ("http://printer.local", True), ("http://a@localhost", True), ("http://example.org@127.0.0.1", True),
    ("http://[::1]", True), ("http://[::]", True), ("http://[fc00::1]", True), ("http://[fd00::1]", True), ("http://[fe80::1]", True), ("http://[febf::1]", True), ("http://1.2.3.256", True), ("http://256.1", True), ("http://a b", True), ("http://?", True),
    ("ftp://example.org", True), ("file://example.org", True), ("mailto:me@example.org", True), ("example.org", True), ("//example.org", True), ("", True),
)
_PATH_OF = r"^(https?)://([^/?#]+)(.*)$"


@_derived("url_unsafe", f"""with y as (select page_id, url, regexp_extract(url, '{_PATH_OF}', 3, 's') as path from pages), guarded(form, before, refused) as (values {', '.join(f"({n}, '{before}', {refused})" for n, (before, refused) in enumerate(_GUARDED, 3))}),
e as (select *, {list(_FIRST_OCTETS)}[(event_id % 8 + 8) % 8 + 1] as a, {list(_SECOND_OCTETS)}[(user_id % 10 + 10) % 10 + 1] as b from events)
select page_id, null::bigint as event_id, form::int as form, url is null or case form when 0 then length(url) > 2048 when 1 then false else true end as unsafe from y, (select unnest(range(3)) as form)
  union all select page_id, null, form, url is null or refused or length(before || path) > 2048 from y, guarded
  union all select null, event_id, form, event_id is null or user_id is null or a in (0, 10, 127) or (a = 100 and b between 64 and 127) or (a = 169 and b = 254) or (a = 172 and b between 16 and 31) or (a = 192 and b = 168) from e, (select unnest(range(10)) as form)""")  # fmt: skip
def _(s, d):
    """URLs of pages, given, of the greatest length and beyond it, and with each beginning of _GUARDED; an address from each event in each spelling: dotted, with a dot at its end, as one number, in hexadecimal, in octal, short, escaped, with user and port, and mapped into IPv6 in two ways."""
    pages = _table(s, d, "pages").withColumn("path", F.regexp_extract("url", "(?s)" + _PATH_OF, 3))
    sized = [F.rpad(F.concat(F.lit("https://example.org"), "path"), n, "a") for n in (urls.MOST_URL_LENGTH, urls.MOST_URL_LENGTH + 1)]
    forms = F.array("url", *sized, *[F.concat(F.lit(before), "path") for before, _ in _GUARDED])
    of_pages = pages.select("page_id", F.lit(None).cast("long").alias("event_id"), F.posexplode(forms).alias("form", "url"))

    i, user = F.col("event_id"), F.col("user_id")
    pick = lambda key, values: _pick(F.pmod(key, F.lit(len(values))), *values).cast("long")
    a, b, c, e = pick(i, _FIRST_OCTETS), pick(user, _SECOND_OCTETS), F.pmod(user, F.lit(256)), F.pmod(i, F.lit(256))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    rest = text(".", b, ".", c, ".", e)
    number = ((a * 256 + b) * 256 + c) * 256 + e
    octal, escaped = F.conv(a.cast("string"), 10, 8), F.regexp_replace(a.cast("string"), r"(\d)", "%3$1")
    hosts = (text(a, rest), text(a, rest, "."), text(number), text("0x", F.hex(number)), text("0", octal, rest), text(a, ".", (b * 256 + c) * 256 + e), text(escaped, rest), text("me@", a, rest, ":8080"), text("[::ffff:", a, rest, "]"), text("[::FFFF:", F.hex(a * 256 + b), ":", F.hex(c * 256 + e), "]"))
    spelled = F.array(*[text("http://", host, "/") for host in hosts])
    events = _table(s, d, "events").select("event_id", "user_id").repartition(s.sparkContext.defaultParallelism, "event_id")  # narrow rows, each of which becomes many
    of_events = events.select(F.lit(None).cast("long").alias("page_id"), "event_id", F.posexplode(spelled).alias("form", "url"))
    return of_pages.unionByName(of_events).select("page_id", "event_id", "form", urls.unsafe("url").alias("unsafe"))


@_derived("url_start", "select page_id, case when page_id % 3 = 0 then url end as url from pages")
def _(s, d):
    bare = F.regexp_replace("url", "^https?://", "")
    given = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("  "), "url", F.lit("\n"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("ftp://"), bare)).otherwise(bare)
    return _table(s, d, "pages").select("page_id", given.alias("given")).select("page_id", urls.start_url("given").alias("url"))


# --- small functions --------------------------------------------------------------------


@_derived("text_durations", "select event_id, case event_id % 7 when 0 then user_id when 1 then user_id when 2 then user_id * 60 when 3 then user_id * 3600 when 4 then user_id * 86400 when 5 then user_id * 3600 end::bigint as seconds from events")
def _(s, d):
    given = F.concat(F.col("user_id").cast("string"), _pick(F.col("event_id"), "", "s", "m", "h", "d", " H ", " weeks"))
    return _table(s, d, "events").select("event_id", tx.seconds(given).alias("seconds"))


@_derived("text_humanize", "select event_id, upper(left(event_type, 1)) || substr(event_type, 2) || (array[' status code', ' per user', '', ' a b'])[event_id % 4 + 1] as words from events")
def _(s, d):
    key = F.concat("event_type", _pick(F.col("event_id"), "StatusCode", "_per-user", "", "_aB"))
    return _table(s, d, "events").select("event_id", tx.humanize(key).alias("words"))


@_derived("text_sorted_json", """select event_id, '{"at":null,"event":{"id":' || event_id || ',"type":"' || event_type || '"},"users":[' || user_id || ',1]}' as sorted from events""")
def _(s, d):
    from .report import sorted_json

    body = F.to_json(F.struct(F.array("user_id", F.lit(1).cast("long")).alias("users"), F.struct(F.col("event_type").alias("type"), F.col("event_id").alias("id")).alias("event"), F.lit(None).cast("string").alias("at")), {"ignoreNullFields": "false"})
    return _table(s, d, "events").select("event_id", sorted_json(body).alias("sorted"))


@_derived("text_utc_minute", "select event_id, strftime(ts, '%Y-%m-%d %H:%M') as minute from events")
def _(s, d):
    return _table(s, d, "events").select("event_id", tx.utc_minute(F.col("ts").cast("timestamp_ntz")).alias("minute"))


_WORKING = STAGES[1:6]


@_derived("audit_stage_states", f"""select o_orderkey, stage, case when o_orderkey % 8 = 7 then 'failed' when o_orderkey % 8 > n or o_orderkey % 8 = 6 then 'done' when o_orderkey % 8 = n then 'current' else 'pending' end as state
  from orders, (values {', '.join(f"({i}, '{x}')" for i, x in enumerate(_WORKING, 1))}) v(n, stage)""")
def _(s, d):
    """Orders as a stand-in for runs, their status from their key."""
    runs = _table(s, d, "orders").select("o_orderkey", _pick(F.col("o_orderkey"), *STAGES).alias("status"))
    states = F.array(*[F.struct(F.lit(x).alias("stage"), read_api.stage_state(F.col("status"), x).alias("state")) for x in _WORKING])
    return runs.select("o_orderkey", F.explode(states).alias("x")).select("o_orderkey", "x.*")


@_derived("read_bounds", """select event_id, case event_id % 5 when 0 then 50 when 1 then least(200, greatest(1, user_id)) when 2 then 1 when 3 then least(200, greatest(1, user_id)) else 50 end::int as lim,
  case event_id % 3 when 0 then 0 when 1 then user_id else 0 end::int as off from events""")
def _(s, d):
    user = F.col("user_id").cast("string")
    limit = _pick(F.col("event_id"), "x", "n", "-7", "n.9", "").cast("string")
    limit = F.replace(limit, F.lit("n"), user)
    offset = F.when(F.col("event_id") % 3 == 1, user).when(F.col("event_id") % 3 == 2, F.concat(F.lit("-"), user))
    return _table(s, d, "events").select("event_id", *read_api.bounded(limit, offset))


@_derived("read_total_pages", "select user_id, count(*) as total, (user_id % 7 + 1)::int as size, greatest(1, (count(*) + user_id % 7) // (user_id % 7 + 1))::bigint as pages from events group by user_id")
def _(s, d):
    counts = _table(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total")).withColumn("size", (F.col("user_id") % 7 + 1).cast("int"))
    return counts.select("user_id", "total", "size", read_api.pages_in(F.col("total"), F.col("size")).alias("pages"))
