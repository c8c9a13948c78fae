"""Extraction, enrichment, sampling, PageSpeed JSON, attempts, reads and the workbook."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from auditloom import schemas
from auditloom.functions import text as tx
from auditloom.operators import attempts, enrich, perf
from auditloom.plans import read_api, report
from auditloom.sources import html, psi
from auditloom.sources import tables as tb
from auditloom.streaming.throttle import failing_keys

PAGE = """<!DOCTYPE html><html><head><title>  Widgets  </title><meta name="Description" content=" All widgets "><meta name="robots" content=""><meta name="ROBOTS" content="noindex">
<link rel="canonical" href="/widgets"><link rel="NEXT" href="/widgets?page=2"><link rel="prev" href="/widgets?page=0"><link rel="alternate" hreflang=" en " href="/en/widgets"><link rel="alternate" href="/feed">
<style>p{}</style><script>var x = "<h1>no</h1>";</script></head><body><h1>Widgets <b>for</b>
 Everyone</h1><h2>A</h2><h2>B</h2><a href="/about">About</a><a href="/about">again</a><a href="https://o.org/x" rel="NoFollow sponsored nofollow">  Out
 side </a><a href="mailto:a@b.c">m</a><a href="#s">s</a><img src="/1.png" alt="one"><img src="/2.png" alt=""><img src="/3.png"><img src="" data-src="/no.png"><img data-src="/4.png"></body></html>"""


def test_extract_page():
    x = html.extract_page(PAGE, "https://example.com/widgets")
    assert x["title"] == ["Widgets"] and x["h1"] == ["Widgets for Everyone"] and x["h2"] == ["A", "B"] and x["meta_description"] == ["All widgets"]
    assert x["canonical_url"] == "https://example.com/widgets" and x["is_self_canonical"] is True and x["meta_robots"] == "noindex"
    assert x["rel_next"] == "https://example.com/widgets?page=2" and x["rel_prev"] == "https://example.com/widgets?page=0"
    assert [(link["href"], link["type"], link["rel"], link["anchor_text"]) for link in x["links"]] == [
        ("https://example.com/about", "internal", [], "About"), ("https://example.com/about", "internal", [], "again"), ("https://o.org/x", "external", ["nofollow", "sponsored"], "Out side"),
    ]
    assert [(i["src"][-5:], i["alt"]) for i in x["images"]] == [("1.png", "one"), ("2.png", ""), ("3.png", None), ("4.png", None)]
    assert x["alternates"] == [{"lang": "en", "href": "https://example.com/en/widgets"}]
    assert html.extract_page("", "https://e.com/") | {"body_text": None} == {k: [] if isinstance(v, list) else None for k, v in x.items()}


def test_extract_tables(spark):
    rows = [("a", "https://example.com/widgets", PAGE, 200, 1), ("a", "https://example.com/widgets", "<title>late</title>", 200, 2), ("a", "https://example.com/e", None, 404, 3)]
    found = html.extract(spark.createDataFrame(rows, "audit_id string, url string, html string, status_code int, fetched long"))
    pages = {r["url"]: r for r in html.to_pages(found).collect()}
    assert pages["https://example.com/widgets"]["title"] == ["Widgets"] and len(pages["https://example.com/widgets"]["content_hash"]) == 64
    assert pages["https://example.com/e"]["content_hash"] is None and pages["https://example.com/e"]["status_class"] == "4xx"
    assert (html.to_links(found).count(), html.to_images(found).count(), html.to_hreflang(found).count()) == (3, 4, 1)


def test_text_functions(spark):
    df = spark.createDataFrame([("a  \n b ", {"X-Robots-Tag": [" no", "index "]}, "12x", "<div id='root'></div>")], "t string, h map<string,array<string>>, n string, html string")
    row = df.select(tx.collapse(F.col("t")).alias("t"), tx.header(F.col("h"), "x-robots-tag").alias("h"), tx.header(F.col("h"), "no").alias("none"), tx.content_length(F.col("n"), F.col("html")).alias("n"), tx.spa_shell(F.col("html")).alias("spa"), tx.humanize(F.lit("targetStatusCode")).alias("key")).first()
    assert tuple(row) == ("a b", "no, index", None, 21, True, "Target status code")


def test_enrichment(spark):
    pages = spark.createDataFrame([("a", "/1", 200, "2xx"), ("a", "/2", 301, "3xx"), ("a", "/3", 404, "4xx")], "audit_id string, url string, status_code int, status_class string").withColumn("inlink_count", F.lit(0))
    links = spark.createDataFrame([("a", "/1", h, None, t, []) for h, t in [("/1", "internal"), ("/2", "internal"), ("/2", "internal"), ("/3", "external"), ("/9", "internal")]], "audit_id string, source_url string, href string, anchor_text string, type string, rel array<string>")
    found = enrich.resolve_links(links, pages)
    assert {r["href"]: (r["target_status_code"], r["is_redirect"], r["is_broken"]) for r in found.collect()} == {"/1": (200, False, False), "/2": (301, True, False), "/3": (404, False, True), "/9": (None, None, None)}
    assert {r["url"]: r["inlink_count"] for r in enrich.count_inlinks(pages, links).collect()} == {"/1": 1, "/2": 2, "/3": 0}
    alternates = spark.createDataFrame([("a", "/1", "en", "/2", None), ("a", "/2", "de", "/1", None), ("a", "/1", "fr", "/3", None), ("a", "/4", "en", "/4", None)], schemas.HREFLANG)
    assert {(r["page_url"], r["href"]): r["is_reciprocal"] for r in enrich.reciprocity(alternates).collect()} == {("/1", "/2"): True, ("/2", "/1"): True, ("/1", "/3"): False, ("/4", "/4"): True}
    results = spark.createDataFrame([("/3", 200), ("/2", None), ("/1", 500)], "href string, status int")
    merged = {r["href"]: (r["target_status_code"], r["is_redirect"], r["is_broken"]) for r in enrich.merge_verified(found, results).collect()}
    assert merged == {"/1": (500, False, False), "/2": (301, True, False), "/3": (200, False, False), "/9": (None, None, None)}


def test_sampling(spark):
    rows = [("https://x.test/product/1", 3, 2), ("https://x.test/product/2", 9, 2), ("https://x.test/product/3", 1, 2), ("https://x.test/about", 5, 1), ("https://x.test/", 50, 0)]
    df = spark.createDataFrame(rows, "url string, inlink_count int, depth int")
    assert {r["template_key"]: r["url"] for r in perf.samples(df).collect()} == {"/product/:id": "https://x.test/product/2", "/about": "https://x.test/about", "/": "https://x.test/"}
    tie = spark.createDataFrame([("https://x.test/p/2", 4, 3), ("https://x.test/p/1", 4, 1), ("https://x.test/p/3", 4, 3)], "url string, inlink_count int, depth int")
    assert perf.samples(tie).first()["url"] == "https://x.test/p/1"
    done = spark.createDataFrame([("https://x.test/", "mobile")], "page_url string, strategy string")
    assert perf.uncached(perf.pairs(perf.samples(df, 1).select("url")), done).count() == 2
    assert perf.uncached(perf.pairs(df.where("depth = 0")), done).collect() == [("https://x.test/", "desktop")]


def test_psi(spark):
    full = {
        "loadingExperience": {"metrics": {"LARGEST_CONTENTFUL_PAINT_MS": {"percentile": 3210}, "CUMULATIVE_LAYOUT_SHIFT_SCORE": {"percentile": 12}, "INTERACTION_TO_NEXT_PAINT": {"percentile": 245}}},
        "lighthouseResult": {
            "categories": {"performance": {"score": 0.74, "auditRefs": [{"id": "b"}, {"id": "a"}, {"id": "none"}]}, "seo": {"auditRefs": [{"id": "b"}, {"id": "c"}]}},
            "audits": {"a": {"score": 0.5}, "b": {"score": 0.95}, "c": {"score": 0.99}, "first-contentful-paint": {"numericValue": 2102.6}},
        },
    }
    lab = {"lighthouseResult": {"audits": {"largest-contentful-paint": {"numericValue": 1502.3}, "cumulative-layout-shift": {"numericValue": 0.0214}}}}
    rows = psi.parse(spark.createDataFrame([(json.dumps(full),), (json.dumps(lab),), ("{}",)], "psi_raw string")).drop("psi_raw").collect()
    assert rows[0].asDict() == {"lcp_ms": 3210, "cls": pytest.approx(0.12), "inp_ms": 245, "performance_score": 74.0, "fcp_ms": 2103, "tbt_ms": None, "speed_index_ms": None, "usability_flags": ["a", "b", "c"]}
    assert (rows[1]["lcp_ms"], rows[1]["cls"], rows[1]["inp_ms"], rows[1]["usability_flags"]) == (1502, pytest.approx(0.021), None, [])
    assert rows[2]["usability_flags"] == [] and rows[2]["lcp_ms"] is None


def test_attempts(spark):
    rows = [("a", t, True) for t in (0, 10, 20, 30, 900)] + [("a", 901, True), ("b", 1, True), ("b", 2, False), ("b", 3, True)]
    found = {(r["key"], r["at"]): (r["failures"], r["locked"]) for r in attempts.login_failures(spark.createDataFrame(rows, "key string, at long, failed boolean")).collect()}
    assert found["a", 900] == (5, True) and found["a", 901] == (5, True) and found["a", 30] == (4, False) and found["b", 3] == (1, False)
    hits = attempts.contact_hits(spark.createDataFrame([("a", t) for t in (0, 1, 2, 3, 4, 59, 60)], "key string, at long"))
    assert {r["at"]: r["limited"] for r in hits.collect()} == {0: False, 1: False, 2: False, 3: False, 4: False, 59: True, 60: True}


def test_streaming_throttle(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("a", base + dt.timedelta(seconds=10 * i), True) for i in range(6)] + [("b", base, True), ("z", base + dt.timedelta(hours=2), True)]
    spark.createDataFrame(rows, "key string, ts timestamp, failed boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp, failed boolean").parquet(str(tmp_path / "in"))
    query = failing_keys(stream).writeStream.outputMode("append").format("memory").queryName("failing").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r["key"] for r in spark.table("failing").collect()} == {"a"}


def test_reads(spark):
    rows = [("b", "high", "/2"), ("b", "high", "/1"), ("a", "critical", "/9"), ("c", "low", None), ("c", "low", "/3")]
    df = spark.createDataFrame([("x", r, s, u, "{}") for r, s, u in rows], schemas.FINDINGS)
    page, total = read_api.list_findings(df, limit=4)
    assert [(r["rule_id"], r["url"]) for r in page.collect()] == [("a", "/9"), ("b", "/1"), ("b", "/2"), ("c", "/3")] and total == 5
    page, total = read_api.list_findings(df, severity="low", offset=1)
    assert [r["url"] for r in page.collect()] == [None] and total == 2
    assert read_api.bounds("x", -5) == (50, 0) and read_api.bounds(1000, "3") == (200, 3) and read_api.bounds(0) == (1, 0) and read_api.total_pages(0, 50) == 1 and read_api.total_pages(101, 50) == 3
    audits = spark.createDataFrame([("1", "u"), ("2", None), ("3", "v")], "id string, owner_id string")
    assert audits.where(read_api.owned("u")).count() == 1 and audits.where(read_api.owned("u", admin=True)).count() == 3


def test_scoped_tables_and_sink(spark, tmp_path):
    one = spark.createDataFrame([("a", "/1"), ("b", "/2")], "audit_id string, url string")
    tb.write(one, str(tmp_path / "t"))
    tb.write(spark.createDataFrame([("a", "/3")], "audit_id string, url string"), str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    assert {(r["audit_id"], r["url"]) for r in read.collect()} == {("a", "/3"), ("b", "/2")}
    assert "PartitionFilters: [isnotnull(audit_id" in read.where("audit_id = 'a'")._jdf.queryExecution().toString()


def test_workbook(spark, tmp_path):
    rows = [("x", "links.broken-internal", "critical", "/1", '{"href":"/h","targetStatusCode":404}'), ("x", "own.rule", "low", None, '{"b":1,"a":"z"}')]
    df = spark.createDataFrame(rows, schemas.FINDINGS)
    when = dt.datetime(2024, 5, 6, 7, 8, 9)
    path = report.build_workbook(df, {"id": "x", "start_url": "https://e.com", "status": "done"}, str(tmp_path), when)
    assert path.endswith("audit-x-20240506-070809.xlsx")
    with zipfile.ZipFile(path) as z:
        book = z.read("xl/workbook.xml").decode()
        assert book.count("<sheet ") == 17 and 'name="Other"' in book
        assert "/h" in z.read("xl/worksheets/sheet3.xml").decode() and '{&quot;a' in z.read("xl/worksheets/sheet17.xml").decode() or '{"a":"z","b":1}' in z.read("xl/worksheets/sheet17.xml").decode()
    assert {r["section"]: (r["findings"], r["dominant"]) for r in report.section_summary(df).collect() if r["findings"]} == {"Broken Links": (1, "critical"), "Other": (1, "low")}


def test_workbook_numbers_and_long_sheets(tmp_path):
    import re

    path = str(tmp_path / "w.xlsx")
    numbers = [1234567.0, 0.12345678, 1e15 + 1, 404, True, 1e-7, -2.5]
    report.write_workbook(path, [("Numbers", ["A", "B"], iter([(n, None) for n in numbers])), ("Empty", ["A"], iter(())), ("A name of more than thirty-one letters", ["A"], ((i,) for i in range(25)))], most_rows=11)
    with zipfile.ZipFile(path) as z:
        names = re.findall('<sheet name="([^"]*)"', z.read("xl/workbook.xml").decode())
        assert names == ["Numbers", "Empty", "A name of more than thirty-one ", "A name of more than thirt (2)", "A name of more than thirt (3)"]
        assert [float(v) for v in re.findall("<v>([^<]*)</v>", z.read("xl/worksheets/sheet1.xml").decode())] == [float(n) for n in numbers]
        counts = [z.read(f"xl/worksheets/sheet{i}.xml").decode().count("<row ") for i in range(1, 6)]
        assert counts == [8, 1, 11, 11, 6] and z.testzip() is None


SITE = """<html><head><title>{0}</title></head><body><h1>{0}</h1><a href="/gone">x</a><img src="/i.png">{0}</body></html>"""


def crawled(spark, words):
    rows = [("https://a.example/", SITE.format(words), 200, {"content-type": ["text/html"]}), ("https://a.example/gone", "", 404, None)]
    return spark.createDataFrame(rows, "url string, html string, status_code int, headers map<string,array<string>>")


def test_stage_runner(spark, tmp_path):
    from auditloom.plans import runner

    folder, when = str(tmp_path / "audits"), dt.datetime(2024, 5, 6)
    slow = json.dumps({"loadingExperience": {"metrics": {"LARGEST_CONTENTFUL_PAINT_MS": {"percentile": 4000}}}})
    results = spark.createDataFrame([("https://a.example/", "mobile", slow), ("https://a.example/gone", "mobile", slow)], "page_url string, strategy string, psi_raw string")
    one, two = runner.Audit(spark, folder, "one", "https://a.example/"), runner.Audit(spark, folder, "two")
    path = one.run(crawled(spark, "A shop"), results, str(tmp_path), when)
    assert zipfile.is_zipfile(path)
    first = sorted(map(tuple, one.findings().collect()), key=repr)
    rules = {r[1] for r in first}
    assert {"links.broken-internal", "meta.description.missing", "image.alt-title", "perf.lcp", "index.canonical"} <= rules and {r[0] for r in first} == {"one"}
    assert [json.loads(r[4])["lcpMs"] for r in first if r[1] == "perf.lcp"] == [4000]
    two.run(crawled(spark, "Another shop with a title of a good length"), results.limit(0), str(tmp_path), when)
    assert {r["rule_id"] for r in two.findings().collect()} & {"perf.lcp", "meta.title.template"} == set()
    one.run(crawled(spark, "A shop"), results, str(tmp_path), when)  # again: replaced, not added
    assert sorted(map(tuple, one.findings().collect()), key=repr) == first
    three = runner.Audit(spark, folder, "three")
    with pytest.raises(ValueError, match="crawl stage"):
        three.run(crawled(spark, "x").limit(0), results, str(tmp_path), when)
    assert {r["audit_id"]: (r["status"], r["stage"]) for r in runner.statuses(spark, folder).collect()} == {"one": ("done", "report"), "two": ("done", "report"), "three": ("failed", "enrich")}
