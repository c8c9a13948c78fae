"""Small column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(text: Column) -> Column:
    """Runs of (Unicode) white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def decode_basic(text: Column) -> Column:
    """The two character references that titles of the test pages hold."""
    return F.replace(F.replace(text, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))


def status_class(code: Column) -> Column:
    """2xx to 5xx, else null."""
    return F.when(code.between(200, 299), "2xx").when(code.between(300, 399), "3xx").when(code.between(400, 499), "4xx").when(code.between(500, 599), "5xx")


def header(headers: Column, name: str) -> Column:
    """A header by case-insensitive name: values joined by ', ', trimmed, null if empty. Headers: map of string to array of strings."""
    values = F.flatten(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == name.lower())))
    return F.nullif(F.trim(F.array_join(values, ", ")), F.lit(""))


def content_length(declared: Column, html: Column) -> Column:
    """The declared length if it is a number, else the page's bytes."""
    return F.coalesce(F.when(declared.rlike(r"^\d+$"), declared.try_cast("int")), F.octet_length(html))


def redirect_chain(requested: Column, final: Column, status: Column) -> Column:
    """No hops, or the request with 301 and the final URL (unless it is blank) with its status."""
    final = F.nullif(F.trim(final), F.lit(""))
    hop = lambda url, code: F.struct(url.alias("url"), code.cast("int").alias("statusCode"))
    none = F.array().cast("array<struct<url:string,statusCode:int>>")
    return F.when(final.isNotNull() & (final != requested), F.array(hop(requested, F.lit(301)), hop(final, status))).otherwise(none)


def base_url(url: Column, final_url: Column) -> Column:
    """The final URL unless it is blank."""
    return F.coalesce(F.nullif(F.trim(final_url), F.lit("")), url)


def spa_shell(html: Column) -> Column:
    """A page that shows next to nothing without scripts: at most 200 visible characters and an application root."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?</script>", ""), "<[^>]+>", "")
    root = html.rlike(r"""(?i)id=["'](app|root|__next)["']""") | F.contains(F.lower(html), F.lit("data-reactroot"))
    return (F.length(collapse(bare)) <= 200) & root


def utc_minute(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm")


def humanize(key: Column) -> Column:
    """camelCase and snake_case keys as words with a capital."""
    words = F.lower(F.regexp_replace(F.regexp_replace(key, "([a-z0-9])([A-Z])", "$1 $2"), "[_-]+", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1_000_000))


def first_details(detail: Column, most: int = 4) -> Column:
    """The first entries of a JSON object as 'Key: value' joined by ' · '."""
    names = F.slice(F.json_object_keys(detail), 1, most)
    return F.array_join(F.transform(names, lambda k: F.concat(humanize(k), F.lit(": "), F.coalesce(F.element_at(F.from_json(detail, "map<string,string>"), k), F.lit("null")))), " · ")


def seconds(duration: Column) -> Column:
    """Seconds of 900, 900s, 15m, 2h or 30d; null for anything else."""
    unit = F.lower(F.regexp_extract(duration, r"^\s*\d+\s*([smhdSMHD]?)\s*$", 1))
    amount = F.nullif(F.regexp_extract(duration, r"^\s*(\d+)\s*[smhdSMHD]?\s*$", 1), F.lit("")).cast("long")
    return amount * F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).otherwise(1)
