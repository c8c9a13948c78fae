"""DuckDB SQL of the derived tables and of every query over them."""

from __future__ import annotations

#: The derived tables of ``sources.demo``, enriched, as common table expressions.
VIEWS = r"""
with src as (
  select page_id as i, regexp_replace(url, '#.*$', '') as u,
         replace(replace(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '&quot;', '"'), '&amp;', '&') as t,
         replace(replace(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')), '&quot;', '"'), '&amp;', '&') as h
  from pages
), cnt as (select count(*) as n from src),
kinds as (
  select i, t, h, 0 as kind, u as url, case i % 20 when 3 then 301 when 7 then 404 when 13 then 500 else 200 end as status_code from src
  union all
  select i, t, h, 1, case when starts_with(u, 'https://') then 'http://' || substr(u, 9) else 'https://' || substr(u, 8) end, 200 from src where i % 15 = 2
  union all
  select i, t, h, 2, u || '/', 200 from src where i % 5 = 1 and not contains(u, '?') and not ends_with(u, '/')
), firsts as (
  select * from kinds qualify row_number() over (partition by url order by kind, i) = 1
), based as (
  select f.*, n, (select u from src s where s.i = (f.i + 1) % n) as u_next, (select u from src s where s.i = (f.i - 1 + n) % n) as u_prev
  from firsts f, cnt
), hashes as (
  select doc_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) as content_hash from documents
), p0 as (
  select url, status_code, case when status_code between 200 and 299 then '2xx' when status_code between 300 and 399 then '3xx' when status_code between 400 and 499 then '4xx' else '5xx' end as status_class,
         case when i % 25 = 4 then [url, u_next] when i % 50 = 9 then [url, u_next, url] else [] end as hops, (i % 4)::int as depth,
         case i % 17 when 0 then [] when 1 then [t, t || ' 2'] when 2 then [t || ' ' || t] else [t] end as title,
         case i % 11 when 0 then [] when 1 then [t, t || ' 2'] when 2 then [repeat(t || ' ', 4)] else [t] end as meta_description,
         case i % 19 when 0 then [] when 1 then [h, h || ' 2'] when 2 then [h || ' ' || h] else [h] end as h1,
         case i % 6 when 0 then null when 1 then u_next else url end as canonical_url,
         case when i % 13 = 0 then 'NoIndex, follow' else 'index, follow' end as meta_robots, case when i % 29 = 1 then 'noindex' end as x_robots_tag, i % 31 = 2 as blocked_by_robots_txt,
         case when kind = 0 and i % 10 < 5 then u_next end as rel_next, case when kind = 0 and i % 10 between 1 and 5 and i % 10 <> 2 then u_prev end as rel_prev,
         content_hash
  from based left join hashes on doc_id = case when i % 9 = 1 then i - 1 else i end
), l0 as (
  select u as source_url, (select s.u from src s where s.i = (7 * src.i + 3 * k) % n) as href, case when i % 4 = 0 then 'external' else 'internal' end as type,
         case i % 3 when 0 then ['nofollow'] when 1 then ['noopener'] else [] end as rel
  from src, cnt, (select unnest(range(5)) as k)
  union all
  select u, 'https://uncrawled.example.org/' || i, 'external', ['ugc'] from src
), links as (
  select l0.*, status_code as target_status_code, status_class = '3xx' as is_redirect, status_class in ('4xx', '5xx') as is_broken from l0 left join p0 on p0.url = l0.href
), p as (
  select p0.*, canonical_url = url as is_self_canonical, coalesce(n, 0) as inlink_count
  from p0 left join (select href, count(*) as n from links where type = 'internal' group by href) using (url) 
), images as (
  select u as page_url, (select s.u from src s where s.i = (3 * src.i + 1) % n) as src, case i % 3 when 1 then '' when 2 then 'alt' end as alt from src, cnt
), im as (
  select images.*, status_code from images left join p0 on p0.url = images.src
), h0 as (
  select u as page_url, case i % 8 when 5 then 'EN_us' when 6 then 'x-default' else 'en-US' end as lang,
         (select s.u from src s where s.i = case when src.i % 2 = 0 then src.i + 1 when src.i % 4 = 1 then src.i - 1 else (src.i + 2) % n end) as href
  from src, cnt where i < n - 1
), hl as (
  select h0.*, exists (select 1 from h0 b where b.page_url = h0.href and b.href = h0.page_url) as is_reciprocal from h0
), cents as (
  select user_id % n as i, case when event_id % 2 = 0 then 'mobile' else 'desktop' end as strategy, floor(value * 100)::bigint as c, event_type, value from events, cnt
), perf as (
  select u as page_url, strategy, (sum(c)::bigint // (2 * count(*)))::int as lcp_ms, ((sum(c)::bigint // (500 * count(*)))::double / 100.0::double + 0.005::double)::float as cls,
         ((min(c) * 150) // 100)::int as inp_ms, list_sort(coalesce(list(distinct event_type) filter (where value > 200), [])) as flags
  from cents join src using (i) group by i, u, strategy
), ok as (select * from p where status_class = '2xx')
"""
VIEWS = VIEWS.replace("from p0 left join (select href, count(*) as n from links where type = 'internal' group by href) using (url) ", "from p0 left join (select href as url, count(*) as n from links where type = 'internal' group by href) using (url)")


def _join(column: str) -> str:
    return f"array_to_string({column}, '|')"


def _duplicates(column: str, key: str, present: str) -> str:
    return f"select url, k as \"{key}\", n as \"duplicateCount\" from (select url, {column} as k, count(*) over (partition by {column}) as n from ok where {present}) where n > 1 and k is not null"


def _template(column: str, key: str, shortest: int, longest: int) -> str:
    return f"select url, {column}[1] as {key}, length({column}[1]) as length, case when length({column}[1]) < {shortest} then 'too-short' else 'too-long' end as recommendation from ok where length({column}[1]) not between {shortest} and {longest}"


CHECKS = {
    "mirror.main-mirror": f"""select url, k as "variantKey", {_join('v')} as variants, len(v)::bigint as "mirrorCount" from (
        select url, regexp_replace(regexp_replace(url, '^https?://', ''), '^www\\.', '') as k from ok) join (
        select regexp_replace(regexp_replace(url, '^https?://', ''), '^www\\.', '') as k, list_sort(list(distinct regexp_extract(url, '^(https?://[^/]+)', 1))) as v from ok group by 1 having len(v) > 1) using (k)""",
    "mirror.trailing-slash": """select a.url, b.url as "slashUrl", a.content_hash as "contentHash" from ok a join ok b on b.url = a.url || '/' and a.content_hash = b.content_hash where not ends_with(a.url, '/')""",
    "links.internal-redirect": """select distinct source_url as url, href, target_status_code as "targetStatusCode" from links where type = 'internal' and is_redirect""",
    "links.redirect-chain": f"""select url, len(hops)::bigint as hops, len(hops) > len(list_distinct(hops)) as "isLoop", {_join('hops')} as chain from p where len(hops) > 1""",
    "links.broken-internal": """select distinct source_url as url, href, target_status_code as "targetStatusCode" from links where type = 'internal' and is_broken""",
    "links.broken-external": """select distinct source_url as url, href, target_status_code as "targetStatusCode" from links where type = 'external' and is_broken""",
    "links.external-flag": f"""select distinct source_url as url, href, {_join('rel')} as rel from links where type = 'external' and not list_has_any(rel, ['nofollow', 'sponsored', 'ugc'])""",
    "dupe.content": _duplicates("content_hash", "contentHash", "content_hash is not null"),
    "index.canonical": """select url, case when canonical_url is null then 'missing' else 'non-self' end as issue, canonical_url as "canonicalUrl" from ok where canonical_url is null or not is_self_canonical""",
    "index.robots": """select url, concat_ws('|', case when meta_robots ilike '%noindex%' then 'meta-noindex' end, case when x_robots_tag ilike '%noindex%' then 'header-noindex' end, case when blocked_by_robots_txt then 'robots-txt-blocked' end) as reason,
        meta_robots as "metaRobots", x_robots_tag as "xRobotsTag", blocked_by_robots_txt as "blockedByRobotsTxt" from ok where meta_robots ilike '%noindex%' or x_robots_tag ilike '%noindex%' or blocked_by_robots_txt""",
    "index.url-heuristics": """select * from (select url, concat_ws('|', case when regexp_matches(regexp_replace(url, '^https?://[^/]+', ''), '[A-Z]') then 'uppercase' end,
        case when contains(regexp_replace(url, '^https?://[^/]+', ''), '_') then 'underscore' end, case when contains(url, '?') then 'query-params' end, case when length(url) > 115 then 'too-long' end) as issues from ok) where issues <> ''""",
    "pagination.rel": """select * from (select a.url, a.rel_next as "relNext", case when b.url is null then 'next-target-missing' when b.rel_prev is distinct from a.url then 'next-not-reciprocal' end as issue
        from ok a left join ok b on b.url = a.rel_next where a.rel_next is not null) where issue is not null""",
    "i18n.hreflang": """select * from (select page_url as url, lang, href, concat_ws(',', case when is_reciprocal is not true then 'non-reciprocal' end,
        case when not (lang = 'x-default' or regexp_matches(lang, '(?i)^[a-z]{2,3}(-[a-z0-9]{2,8})*$')) then 'invalid-lang' end) as issue from hl) where issue <> ''""",
    "image.alt-title": """select distinct page_url as url, src, alt, case when alt is null then 'missing' else 'empty' end as "altState" from im where alt is null or alt = ''""",
    "image.broken": """select distinct page_url as url, src, status_code as "statusCode" from im where status_code >= 400""",
    "perf.lcp": """select page_url as url, strategy, lcp_ms as "lcpMs" from perf where lcp_ms > 2500""",
    "perf.cls-inp": """select page_url as url, strategy, cls::double as cls, inp_ms as "inpMs", concat_ws('|', case when cls::double > 0.1 then 'cls' end, case when inp_ms > 200 then 'inp' end) as issues from perf where cls::double > 0.1 or inp_ms > 200""",
    "perf.psi-usability": f"""select page_url as url, strategy, {_join('flags')} as flags from perf where len(flags) > 0""",
    "perf.mobile-indexing": f"""select page_url as url, strategy, {_join('flags')} as flags from perf where len(flags) > 0 and strategy = 'mobile'""",
}
for _name, _column, _key, _low, _high in (("title", "title", "title", 30, 60), ("description", "meta_description", "description", 70, 160), ("h1", "h1", "h1", 20, 70)):
    CHECKS |= {
        f"meta.{_name}.missing": f"select url from ok where len({_column}) = 0",
        f"meta.{_name}.duplicate": _duplicates(f"{_column}[1]", _key, f"len({_column}) >= 1"),
        f"meta.{_name}.multiple": f"select url, {_join(_column)} as {_key}s, len({_column})::bigint as count from ok where len({_column}) > 1",
        f"meta.{_name}.template": _template(_column, _key, _low, _high),
    }


def check_sql(check_id: str) -> str:
    """A check over the derived tables."""
    return VIEWS + CHECKS[check_id]


def findings_cte(severities: dict[str, str]) -> str:
    """``VIEWS`` and a table ``f`` of (rule_id, severity, url) of all findings."""
    parts = " union all ".join(f"select '{r}' as rule_id, '{s}' as severity, url from ({CHECKS[r]})" for r, s in severities.items())
    return f"{VIEWS}, f as ({parts}), ranked as (select *, case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end as rank from f)\n"
