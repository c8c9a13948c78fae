"""Extraction, small functions and read bounds on rows whose results are written down by hand."""

import pytest
from pyspark.sql import functions as F

from auditloom.functions import text as tx
from auditloom.plans import read_api
from auditloom.plans.report import sorted_json
from auditloom.sources import html

HOME, LIST = "https://shop.test/", "https://shop.test/list?page=2"
SITE = [
    (HOME, None, 200, {"Content-Type": ["text/html; charset=utf-8"], "X-Robots-Tag": ["noarchive", "noindex"]},
     """<html><head><title> Shop </title><title>Second</title><meta name=" DESCRIPTION " content=" All we sell "><meta name="robots" content=""><meta name="robots" content="index">
     <link rel="canonical" href="/?b=1&amp;a=2#x"><link rel="alternate" hreflang="de" href="/de"><link rel="alternate" hreflang=" x-default " href="."><link rel="alternate" href="/feed"></head>
     <body><h1>Our <b>shop</b></h1><h2>New</h2><h2> </h2><a href="list?page=2">More</a><a href="list?page=2#top"> More
     again </a><a href="//other.test/a" rel="NoFollow ugc nofollow"></a><a href="mailto:a@b.test">m</a><img src="/a.png" alt="A"><img src="b.png" alt="" title="t"><img data-src="c.png"><img src="" data-src="d.png"></body></html>""", 1),
    (LIST, "https://shop.test/list", 301, {"content-length": ["77"]}, "<html><head><link rel=prev href=/><link rel='next nofollow' href='http://'><link rel=NEXT href='?page=3'></head><body></body></html>", 2),
    (HOME, None, 200, None, "<title>late copy</title>", 3),
    ("https://shop.test/gone", " ", 404, None, None, 4),
]
KIND = "url string, final_url string, status_code int, headers map<string,array<string>>, html string, fetched long"


@pytest.fixture
def found(spark):
    return html.extract(spark.createDataFrame(SITE, KIND).withColumn("audit_id", F.lit("a")))


def test_pages(found):
    pages = {r["url"]: r for r in html.to_pages(found).collect()}
    home, page, gone = pages[HOME], pages[LIST], pages["https://shop.test/gone"]
    assert (home["title"], home["meta_description"], home["h1"], home["h2"]) == (["Shop", "Second"], ["All we sell"], ["Our shop"], ["New"])
    assert (home["canonical_url"], home["is_self_canonical"], home["meta_robots"], home["x_robots_tag"]) == ("https://shop.test/?a=2&b=1", False, "index", "noarchive, noindex")
    assert (home["status_class"], home["content_length_bytes"], home["redirect_chain"]) == ("2xx", len(SITE[0][4].encode()), []) and home["content_hash"]
    assert ([tuple(h) for h in page["redirect_chain"]], page["content_length_bytes"], page["rel_next"], page["rel_prev"]) == ([(LIST, 301), ("https://shop.test/list", 301)], 77, "https://shop.test/list?page=3", HOME)
    assert (gone["status_class"], gone["title"], gone["content_hash"], gone["redirect_chain"]) == ("4xx", [], None, [])


def test_links_images_alternates(found):
    assert [(r["href"], r["anchor_text"], r["type"], r["rel"]) for r in html.to_links(found).collect()] == [(LIST, "More", "internal", []), (LIST, "More again", "internal", []), ("https://other.test/a", None, "external", ["nofollow", "ugc"])]
    assert [(r["src"], r["alt"], r["title"]) for r in html.to_images(found).collect()] == [(HOME + "a.png", "A", None), (HOME + "b.png", "", "t"), (HOME + "c.png", None, None)]
    assert [(r["lang"], r["href"]) for r in html.to_hreflang(found).collect()] == [("de", HOME + "de"), ("x-default", HOME)]


def test_small_functions(spark):
    def of(values, function):
        rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").orderBy("i").select(function(F.col("v")).alias("x")).collect()
        return [r["x"] for r in rows]

    assert of(["900", "900s", "15m", "2h", "30d", "2H", "x", "5 weeks"], tx.seconds) == [900, 900, 900, 7200, 2592000, 7200, None, None]
    assert of(["targetStatusCode", "isLoop", "alt_state", "url"], tx.humanize) == ["Target status code", "Is loop", "Alt state", "Url"]
    assert of(['{"b":1,"a":{"d":null,"c":[2,1]}}', "{}"], sorted_json) == ['{"a":{"c":[2,1],"d":null},"b":1}', "{}"]
    assert of(["2024-05-06 07:08:59"], lambda v: tx.utc_minute(v.cast("timestamp_ntz"))) == ["2024-05-06 07:08"]


def test_bounds_of_one_and_of_many_requests(spark):
    requests = [("x", "-5"), ("1000", "3"), ("0", "0"), ("20", None), (None, "7"), ("7.9", "1.9"), ("inf", "nan"), ("", " "), ("-3", "12")]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(requests)], "i int, l string, o string").orderBy("i").select(*read_api.bounded(F.col("l"), F.col("o"))).collect()
    assert [tuple(r) for r in rows] == [read_api.bounds(*r) for r in requests]
    totals = [(0, 50), (50, 50), (51, 50), (101, 50)]
    pages = spark.createDataFrame(totals, "t int, s int").select(read_api.pages_in(F.col("t"), F.col("s")).alias("n")).collect()
    assert sorted(r["n"] for r in pages) == sorted(read_api.total_pages(*t) for t in totals) == [1, 1, 2, 3]
