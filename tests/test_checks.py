"""Each check on a few seeded rows: what it finds and what it leaves alone."""

import json

import pytest

from auditloom import schemas
from auditloom.operators.checks import REGISTRY
from auditloom.plans import engine, report
from auditloom.sources.tables import MissingStage, Tables

DEFAULTS = {"pages": {"redirect_chain": [], "title": [], "meta_description": [], "h1": [], "h2": [], "depth": 0, "inlink_count": 0, "blocked_by_robots_txt": False}, "links": {"rel": []}, "performance": {"usability_flags": []}}
KINDS = {"pages": schemas.PAGES, "links": schemas.LINKS, "images": schemas.IMAGES, "hreflang": schemas.HREFLANG, "performance": schemas.PERFORMANCE}


def seed(spark, **rows):
    made = {}
    for name, kind in KINDS.items():
        filled = [{"audit_id": "a"} | DEFAULTS.get(name, {}) | r for r in rows.get(name, [])]
        made[name] = spark.createDataFrame([tuple(r.get(c) for c in kind.fieldNames()) for r in filled], kind)
    return Tables(**made)


def run(spark, check_id, **rows):
    found = engine.of_check(REGISTRY[check_id], seed(spark, **rows)).collect()
    return sorted(((r["url"], json.loads(r["detail"])) for r in found), key=lambda x: (x[0], json.dumps(x[1])))


def page(url, status="2xx", **more):
    return {"url": url, "status_class": status} | more


E = "https://example.com"


def test_registry_is_complete():
    covered = [r for s in report.SHEETS for r in s.rules]
    assert len(REGISTRY) == 31 and sorted(covered) == sorted(REGISTRY) and len(set(covered)) == 31
    assert sorted(c.severity for c in REGISTRY.values()).count("critical") == 1


def test_main_mirror(spark):
    both = {"variantKey": "example.com/", "variants": [E, "https://www.example.com"], "mirrorCount": 2}
    found = run(spark, "mirror.main-mirror", pages=[page(f"{E}/"), page("https://www.example.com/"), page(f"{E}/solo")])
    assert found == [(f"{E}/", both), ("https://www.example.com/", both)]
    assert run(spark, "mirror.main-mirror", pages=[page(f"{E}/"), page("https://www.example.com/", "3xx")]) == []


def test_trailing_slash(spark):
    pages = [page(f"{E}/page", content_hash="h1"), page(f"{E}/page/", content_hash="h1"), page(f"{E}/x", content_hash="h2"), page(f"{E}/x/", content_hash="h3"), page(f"{E}/y", content_hash="h4"), page(f"{E}/y/", "3xx", content_hash="h4")]
    assert run(spark, "mirror.trailing-slash", pages=pages) == [(f"{E}/page", {"slashUrl": f"{E}/page/", "contentHash": "h1"})]


def test_redirect_chain(spark):
    hops = lambda *names: [{"url": n, "statusCode": 301} for n in names]
    pages = [page("/chain", redirect_chain=hops("a", "b", "c")), page("/loop", "3xx", redirect_chain=hops("loop", "back", "loop")), page("/single", redirect_chain=hops("a")), page("/plain"), page("/null", redirect_chain=None)]
    found = run(spark, "links.redirect-chain", pages=pages)
    assert [(u, d["hops"], d["isLoop"]) for u, d in found] == [("/chain", 3, False), ("/loop", 3, True)]


def test_broken_and_redirected_links(spark):
    link = lambda href, kind, code, **f: {"source_url": "/p", "href": href, "type": kind, "target_status_code": code, **f}
    links = [link("/gone", "internal", 404, is_broken=True)] * 2 + [link("/ok", "internal", 200, is_broken=False), link("//o/x", "external", 500, is_broken=True), link("/moved", "internal", 301, is_redirect=True), link("/unknown", "internal", None)]
    assert run(spark, "links.broken-internal", links=links) == [("/p", {"href": "/gone", "targetStatusCode": 404})]
    assert run(spark, "links.broken-external", links=links) == [("/p", {"href": "//o/x", "targetStatusCode": 500})]
    assert run(spark, "links.internal-redirect", links=links) == [("/p", {"href": "/moved", "targetStatusCode": 301})]


def test_external_flag(spark):
    links = [{"source_url": "/p", "href": f"//{i}", "type": t, "rel": rel} for i, (t, rel) in enumerate([("external", ["noopener"]), ("external", []), ("external", ["nofollow"]), ("external", ["noopener", "sponsored"]), ("internal", [])])]
    assert run(spark, "links.external-flag", links=links) == [("/p", {"href": "//0", "rel": ["noopener"]}), ("/p", {"href": "//1", "rel": []})]


@pytest.mark.parametrize(("name", "column", "key", "low", "high"), [("title", "title", "title", 30, 60), ("description", "meta_description", "description", 70, 160), ("h1", "h1", "h1", 20, 70)])
def test_elements(spark, name, column, key, low, high):
    pages = [page("/none"), page("/gone", "4xx"), page("/two", **{column: ["x" * low, "y"]}), page("/same", **{column: ["x" * low]}), page("/short", **{column: ["x" * (low - 1)]}), page("/long", **{column: ["x" * (high + 1)]}), page("/edge", **{column: ["x" * high]})]
    assert run(spark, f"meta.{name}.missing", pages=pages) == [("/none", {})]
    assert run(spark, f"meta.{name}.duplicate", pages=pages) == [("/same", {key: "x" * low, "duplicateCount": 2}), ("/two", {key: "x" * low, "duplicateCount": 2})]
    assert run(spark, f"meta.{name}.multiple", pages=pages) == [("/two", {f"{key}s": ["x" * low, "y"], "count": 2})]
    found = run(spark, f"meta.{name}.template", pages=pages)
    assert [(u, d["length"], d["recommendation"]) for u, d in found] == [("/long", high + 1, "too-long"), ("/short", low - 1, "too-short")]


def test_duplicate_content(spark):
    pages = [page("/1", content_hash="d"), page("/2", content_hash="d"), page("/3", content_hash="s"), page("/4"), page("/5"), page("/6", "3xx", content_hash="d")]
    assert run(spark, "dupe.content", pages=pages) == [(u, {"contentHash": "d", "duplicateCount": 2}) for u in ("/1", "/2")]


def test_canonical(spark):
    pages = [page("/1"), page("/2", canonical_url="/o", is_self_canonical=False), page("/3", canonical_url="/3", is_self_canonical=True), page("/4", "4xx"), page("/5", canonical_url="?")]
    assert run(spark, "index.canonical", pages=pages) == [("/1", {"issue": "missing", "canonicalUrl": None}), ("/2", {"issue": "non-self", "canonicalUrl": "/o"})]


def test_robots(spark):
    pages = [page("/1", meta_robots="NoIndex,follow"), page("/2", x_robots_tag="noindex"), page("/3", blocked_by_robots_txt=True), page("/4", meta_robots="noindex", blocked_by_robots_txt=True), page("/5", meta_robots="index"), page("/6", "3xx", meta_robots="noindex")]
    assert [d["reason"] for _, d in run(spark, "index.robots", pages=pages)] == [["meta-noindex"], ["header-noindex"], ["robots-txt-blocked"], ["meta-noindex", "robots-txt-blocked"]]


def test_url_heuristics(spark):
    pages = [page(f"{E}/Path_1?x=1"), page(f"{E}/clean-slug"), page("https://Host_Name.COM/clean"), page(f"{E}/" + "a" * 120), page(f"{E}/Ugly_?", "4xx")]
    assert {u: d["issues"] for u, d in run(spark, "index.url-heuristics", pages=pages)} == {f"{E}/Path_1?x=1": ["uppercase", "underscore", "query-params"], f"{E}/" + "a" * 120: ["too-long"]}


def test_pagination(spark):
    pages = [page("/a", rel_next="/absent"), page("/b", rel_next="/c"), page("/c", rel_prev="/elsewhere"), page("/d", rel_next="/e"), page("/e", rel_prev="/d"), page("/f", rel_next="/g"), page("/g")]
    assert [(u, d["issue"]) for u, d in run(spark, "pagination.rel", pages=pages)] == [("/a", "next-target-missing"), ("/b", "next-not-reciprocal"), ("/f", "next-not-reciprocal")]


def test_hreflang(spark):
    rows = [("en", False), ("EN_us", True), ("nope_bad", False), ("en-US", True), ("x-default", True), ("de", None)]
    found = run(spark, "i18n.hreflang", hreflang=[{"page_url": "/p", "lang": lang, "href": "/q", "is_reciprocal": r} for lang, r in rows])
    assert {d["lang"]: d["issue"] for _, d in found} == {"en": "non-reciprocal", "EN_us": "invalid-lang", "nope_bad": "non-reciprocal,invalid-lang", "de": "non-reciprocal"}


def test_images(spark):
    images = [{"page_url": "/p", "src": s, "alt": a, "status_code": c} for s, a, c in [("1", None, 404), ("2", "", 200), ("3", "logo", None), ("1", None, 404)]]
    assert [(d["src"], d["altState"]) for _, d in run(spark, "image.alt-title", images=images)] == [("1", "missing"), ("2", "empty")]
    assert run(spark, "image.broken", images=images) == [("/p", {"src": "1", "statusCode": 404})]


def test_performance(spark):
    rows = [(0.25, 100, 3000, ["a"], "mobile"), (0.05, 350, 2500, ["b"], "desktop"), (0.05, 100, None, [], "mobile"), (None, None, None, None, "mobile"), (0.1, None, 1, [], "desktop")]
    perf = [{"page_url": f"/{i}", "strategy": s, "cls": c, "inp_ms": n, "lcp_ms": m, "usability_flags": f} for i, (c, n, m, f, s) in enumerate(rows)]
    assert [u for u, _ in run(spark, "perf.lcp", performance=perf)] == ["/0"]
    assert [(u, d["issues"]) for u, d in run(spark, "perf.cls-inp", performance=perf)] == [("/0", ["cls"]), ("/1", ["inp"]), ("/4", [])]
    assert [u for u, _ in run(spark, "perf.psi-usability", performance=perf)] == ["/0", "/1"]
    assert [u for u, _ in run(spark, "perf.mobile-indexing", performance=perf)] == ["/0"]


def test_engine(spark):
    tables = seed(spark, pages=[page("/1"), page("/2", title=["t" * 40], meta_description=["d" * 80], h1=["h" * 30], canonical_url="/2", is_self_canonical=True)])
    once, twice = engine.run_checks(tables), engine.run_checks(tables)
    assert once.failed == () and sorted(map(tuple, once.findings.collect())) == sorted(map(tuple, twice.findings.collect()))
    assert {r["severity"]: r["findings"] for r in engine.by_severity(once.findings).collect()} == {"critical": 0, "high": 3, "medium": 1, "low": 0, "info": 0}
    with pytest.raises(MissingStage):
        engine.run_checks(seed(spark))


def test_a_check_that_cannot_be_planned_is_reported(spark):
    from auditloom.operators.checks import Check

    tables = seed(spark, pages=[page("/1")])
    broken = Check("own.broken", "low", "reads a column that is not there", lambda t: t.pages.select("nothing"))
    ran = engine.run_checks(tables, {"own.broken": broken, "meta.title.missing": REGISTRY["meta.title.missing"]})
    assert ran.failed == ("own.broken",) and ran.findings.count() == 1


def _every_fault(spark):
    pages = [
        page("/1", title=[], meta_description=["d"], h1=["h", "h"], content_hash="c", meta_robots="noindex", redirect_chain=[("/1", 301), ("/x", 301), ("/1", 200)]),
        page("/2", title=["t"], meta_description=["d"], h1=["h"], content_hash="c", canonical_url="/1", is_self_canonical=False, rel_next="/1"),
        page("/2_?q", "4xx", title=["t"], content_hash="c"),
        page("/3", title=["t"], meta_description=["x", "y"], h1=["h"], content_hash=None, blocked_by_robots_txt=True),
    ]
    links = [{"source_url": "/1", "href": f"/{h}", "type": k, "rel": r, "target_status_code": 404, "is_broken": b, "is_redirect": not b} for h, k, r, b in [("a", "internal", [], True), ("a", "internal", [], True), ("b", "external", ["ugc"], True), ("c", "external", None, False), ("d", "internal", [], False)]]
    images = [{"page_url": "/1", "src": s, "alt": a, "status_code": c} for s, a, c in [("1", None, 404), ("1", None, 404), ("2", "", None)]]
    hreflang = [{"page_url": "/1", "lang": "EN_us", "href": "/q", "is_reciprocal": None}]
    perf = [{"page_url": "/1", "strategy": "mobile", "cls": 0.3, "inp_ms": 300, "lcp_ms": 3000, "usability_flags": ["a"]}]
    return seed(spark, pages=pages, links=links, images=images, hreflang=hreflang, performance=perf)


def test_one_pass_findings_equal_those_of_each_check_alone(spark):
    tables = _every_fault(spark)
    alone = [r for c in REGISTRY.values() for r in map(tuple, engine.of_check(c, tables).collect())]
    together = list(map(tuple, engine.run_checks(tables).findings.collect()))
    assert sorted(together, key=repr) == sorted(alone, key=repr) and len({r[1] for r in alone}) >= 24


def test_row_checks_of_a_table_share_one_scan(spark):
    tables = _every_fault(spark)
    local = {k: c for k, c in REGISTRY.items() if c.local}
    plan = engine.run_checks(tables, local).findings._jdf.queryExecution().optimizedPlan().toString()
    assert len(local) == 24 and plan.count("LogicalRDD") + plan.count("LocalRelation") == 5  # pages, links, images, hreflang, performance


def test_a_row_check_that_cannot_be_planned_leaves_the_others_of_its_table(spark):
    from pyspark.sql import functions as F

    from auditloom.operators.checks import Check, Local

    tables = _every_fault(spark)
    bad = Check("own.bad", "low", "", lambda t: t.pages.select("nothing"), local=Local("pages", lambda: (F.col("nothing") > 1, {})))
    ran = engine.run_checks(tables, {"own.bad": bad, "meta.title.missing": REGISTRY["meta.title.missing"], "meta.h1.multiple": REGISTRY["meta.h1.multiple"]})
    assert ran.failed == ("own.bad",) and sorted(r["rule_id"] for r in ran.findings.collect()) == ["meta.h1.multiple", "meta.title.missing"]
    assert engine.run_checks(tables, {"own.bad": bad}).findings.collect() == []
