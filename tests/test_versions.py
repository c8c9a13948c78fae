"""Versioned tables and their log: switches, empty results, crashes, conflicts; the runner on top of them."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from auditloom import schemas
from auditloom.plans import runner
from auditloom.sources import psi, tables
from auditloom.sources.versions import Conflict, Log, Versions

T = schemas.FINDINGS


def found(spark, audit, *urls):
    return spark.createDataFrame([(audit, "r", "low", u, "{}") for u in urls], T)


def urls(df):
    return sorted((r["audit_id"], r["url"]) for r in df.collect())


def test_versions_replace_also_by_nothing(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}")
    assert v.read("findings", T, "a").collect() == [] and v.audits() == []
    assert v.write("a", {"findings": found(spark, "a", "/1", "/2"), "other": found(spark, "a", "/o")}) == 1
    v.write("b/ä", {"findings": found(spark, "b/ä", "/3").unionByName(found(spark, "a", "/not mine"))})
    assert urls(v.read("findings", T)) == [("a", "/1"), ("a", "/2"), ("b/ä", "/3")]
    assert v.write("a", {"findings": found(spark, "a")}) == 2
    assert urls(v.read("findings", T)) == [("b/ä", "/3")] and urls(v.read("findings", T, "a")) == []
    assert urls(v.read("other", T, "a")) == [("a", "/o")]


def test_a_crash_between_two_tables_leaves_the_old_version(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}")
    v.write("a", {"one": found(spark, "a", "/1"), "two": found(spark, "a", "/2")})
    broken = found(spark, "a", "/4").withColumn("url", F.raise_error(F.lit("the executor is gone")))
    with pytest.raises(Exception, match="the executor is gone"):
        v.write("a", {"one": found(spark, "a", "/3"), "two": broken})
    assert urls(v.read("one", T, "a")) == [("a", "/1")] and urls(v.read("two", T, "a")) == [("a", "/2")]
    assert v.clean("a") == 2  # the half-written ones
    assert urls(v.read("one", T, "a")) == [("a", "/1")]
    v.write("a", {"one": found(spark, "a", "/5")})
    assert v.clean("a") == 1 and urls(v.read("one", T, "a")) == [("a", "/5")]


def test_a_table_may_be_read_while_it_is_replaced(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}")
    v.write("a", {"one": found(spark, "a", "/1")})
    old = v.read("one", T, "a")
    v.write("a", {"one": old.unionByName(found(spark, "a", "/2"))})
    assert urls(old) == [("a", "/1")] and urls(v.read("one", T, "a")) == [("a", "/1"), ("a", "/2")]


def test_only_the_audits_folders_are_read(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}")
    for a in "abc":
        v.write(a, {"one": found(spark, a, "/1")})
    files = v.read("one", T, "b").inputFiles()
    assert files and all("/one/b/" in f for f in files)


def test_log_numbers_are_given_once(spark, tmp_path):
    one, two = (Log(spark, f"file://{tmp_path}/log") for _ in range(2))
    assert one.last() == (0, {}) and one.append({"x": 1}, 0) == 1
    with pytest.raises(Conflict):
        two.append({"x": 2}, 0)
    assert two.append({"x": 3}, two.last()[0]) == 2
    assert one.entries() == [{"x": 1}, {"x": 3}]


def test_sink_empties_the_audits_named(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write(found(spark, "a", "/1").unionByName(found(spark, "b c", "/2")), path)
    tables.write(found(spark, "a"), path, "a", "never seen")
    assert urls(spark.read.schema(T).parquet(path)) == [("b c", "/2")]
    tables.write(found(spark, "b c"), path, "b c")
    assert spark.read.schema(T).parquet(path).collect() == []


SITE = """<html><head><title>A shop with a title of a good length</title></head><body><h1>x</h1>{}</body></html>"""
NONE = "page_url string, strategy string, psi_raw string"


def site(spark, links):
    return spark.createDataFrame([("https://a.example/", SITE.format(links), 200), ("https://a.example/gone", "", 404)], "url string, html string, status_code int")


def test_a_site_that_loses_its_last_link_keeps_none(spark, tmp_path):
    one, two = (runner.Audit(spark, f"file://{tmp_path}/audits", a) for a in ("one", "two"))
    results, when = spark.createDataFrame([], NONE), dt.datetime(2024, 5, 6)
    for audit in (one, two):
        audit.run(site(spark, '<a href="/gone">x</a><img src="/i.png">'), results, str(tmp_path), when)
    assert one.findings().where("rule_id = 'links.broken-internal'").count() == 1
    one.run(site(spark, ""), results, str(tmp_path), when)
    assert one.versions.read("crawled_links", schemas.LINKS, "one").count() == 0
    rules = {r["rule_id"] for r in one.findings().collect()}
    assert not rules & {"links.broken-internal", "image.alt-title"} and "index.canonical" in rules
    assert two.findings().where("rule_id = 'links.broken-internal'").count() == 1


def test_two_runs_of_one_audit(spark, tmp_path):
    folder, results, when = f"file://{tmp_path}/audits", spark.createDataFrame([], NONE), dt.datetime(2024, 5, 6)
    late, early = (runner.Audit(spark, folder, "one") for _ in range(2))
    late._begin(False)
    early.run(site(spark, ""), results, str(tmp_path), when)
    with pytest.raises(Conflict):
        late._enter("crawling", "crawl")
    assert [(r["n"], r["status"]) for r in runner.history(spark, folder).orderBy("n").collect()] == list(enumerate(["crawling", "enriching", "analyzing", "measuring", "measuring", "reporting", "done"], 1))
    stuck = runner.Audit(spark, folder, "two")
    stuck._begin(False)
    stuck._enter("enriching", "enrich")  # and then its driver dies
    again = runner.Audit(spark, folder, "two")
    with pytest.raises(Conflict, match="enriching"):
        again.run(site(spark, ""), results, str(tmp_path), when)
    again.run(site(spark, ""), results, str(tmp_path), when, take_over=True)
    with pytest.raises(Conflict):
        stuck._enter("analyzing", "analyze")
    assert {r["audit_id"]: r["status"] for r in runner.statuses(spark, folder).collect()} == {"one": "done", "two": "done"}


BODIES = {
    "good": json.dumps({"loadingExperience": {"metrics": {"LARGEST_CONTENTFUL_PAINT_MS": {"percentile": 4000}}}}), "lab": json.dumps({"lighthouseResult": {"audits": {}}}), "null": None, "blank": "  ",
    "cut": '{"loadingExperience": {"metr', "html": "<html>busy</html>", "wrong type": json.dumps({"loadingExperience": {"metrics": {"A": {"percentile": "fast"}}}}),
    "quota": json.dumps({"error": {"code": 429, "message": "quota"}}), "empty": "{}", "list": "[]",
}


def test_bodies_that_are_no_results(spark):
    rows = spark.createDataFrame(list(BODIES.items()), "page_url string, psi_raw string")
    kept, rejected = psi.read(rows)
    assert {r["page_url"]: r["lcp_ms"] for r in kept.collect()} == {"good": 4000, "lab": None}
    assert {r["page_url"]: r["cause"] for r in rejected.collect()} == {"null": "no body", "blank": "no body", "cut": "malformed", "html": "malformed", "wrong type": "malformed", "quota": "error reply", "empty": "no results", "list": "malformed"}
    assert {r["cause"]: r["n"] for r in psi.rejected_by_cause(rejected).collect()} == {"no body": 2, "malformed": 4, "error reply": 1, "no results": 1}


def test_failed_measurements_and_failed_checks_are_logged(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/audits"
    audit = runner.Audit(spark, folder, "one")
    results = spark.createDataFrame([("https://a.example/", "mobile", "<busy>"), ("https://a.example/", "desktop", BODIES["good"])], NONE)
    monkeypatch.setattr(audit, "analyze", lambda: (runner.Audit.analyze(audit), ("own.bad",))[1])
    crawled = site(spark, "").withColumn("headers", F.create_map(F.lit("content-type"), F.array(F.lit("text/html"))))
    audit.run(crawled, results, str(tmp_path), dt.datetime(2024, 5, 6))
    notes = [r["note"] for r in runner.history(spark, folder).where("note is not null").orderBy("n").collect()]
    assert notes[:2] == ["rules_failed=1: own.bad", "requested=2 cached=0 ok=1 failed=1"]
    assert [(r["strategy"], r["cause"]) for r in audit.rejected().collect()] == [("mobile", "malformed")]
    assert audit.findings().where("rule_id = 'perf.lcp'").count() == 1


def test_upsert_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    from auditloom.operators import perf

    v, P = Versions(spark, f"file://{tmp_path}"), schemas.PERFORMANCE

    def rows(audit, *given):
        return spark.createDataFrame([tuple({"audit_id": audit, "page_url": u, "strategy": s, "lcp_ms": n}.get(c) for c in P.fieldNames()) for u, s, n in given], P)

    def put(audit, *given, **more):
        return v.upsert(audit, "performance", rows(audit, *given), ["audit_id", "page_url", "strategy"], perf.upsert, P, buckets=8, **more)

    def held(audit):
        return {(r["page_url"], r["strategy"]): r["lcp_ms"] for r in v.read("performance", P, audit).collect()}

    first = [(f"/{i}", s, i) for i in range(60) for s in perf.STRATEGIES]
    put("a", *first)
    put("b", ("/1", "mobile", 5))
    files = set(v.read("performance", P, "a").inputFiles())
    assert held("a") == {(u, s): n for u, s, n in first}
    put("a", ("/7", "mobile", 700), others={"rejected": found(spark, "a", "/x")})
    kept = set(v.read("performance", P, "a").inputFiles())
    assert held("a") == {(u, s): n for u, s, n in first} | {("/7", "mobile"): 700} and held("b") == {("/1", "mobile"): 5}
    assert len(files & kept) == len(files) - len(files - kept) >= 7 and len(files - kept) == 1 == len(kept - files)
    put("a", ("/new", "mobile", 1), ("/7", "desktop", 9))
    assert len(held("a")) == 121 and held("a")["/7", "desktop"] == 9
    assert v.clean("a") == 0 and v.clean("b") == 0  # buckets of every version are still read
    assert put("a") == 4 and urls(v.read("rejected", T, "a")) == [("a", "/x")]
    with pytest.raises(ValueError, match="buckets"):
        v.upsert("a", "performance", rows("a"), ["page_url"], perf.upsert, P, buckets=4)
