"""url_unsafe: every kind of URL that the guard tells apart, for every page and event."""

import ipaddress

import duckdb

from auditloom.plans import derived


def test_every_kind_of_url_for_every_page_and_event(spark, tmp_path):
    pages = [(1, "https://example.com/a?b=c#d"), (2, "http://example.com"), (3, None), (4, "https://example.com/" + "a" * 2028), (5, "https://example.com/" + "b" * 2029), (6, "https://example.com/é\n" + "c" * 2020)]
    events = [(i, u) for i in range(8) for u in range(10)] + [(99, None), (None, 7), (-3, -5)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(events, "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    run, sql = derived.QUERIES["url_unsafe"]
    found = [tuple(r) for r in run(spark, str(tmp_path)).select("page_id", "event_id", "form", "unsafe").collect()]
    duck = duckdb.connect()
    for name in ("pages", "events"):
        duck.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(map(repr, found)) == sorted(map(repr, duck.execute(sql).fetchall()))
    kinds = {form for page, _, form, _ in found if page is not None}
    spellings = {form for _, event, form, _ in found if event is not None}
    assert len(found) == len(pages) * len(kinds) + len(events) * len(spellings)
    of = lambda page: {form: unsafe for p, _, form, unsafe in found if p == page}
    assert not of(4)[0] and of(5)[0] and all(of(3).values())
    assert (of(1)[0], of(1)[1], of(1)[2]) == (False, False, True)
    given = {before: of(1)[n] for n, (before, _) in enumerate(derived._GUARDED, 3)}
    for host in ("http://localhost", "http://printer.local", "http://[::1]", "http://[fd00::1]", "http://[fe80::1]", "ftp://example.org", "example.org"):
        assert given[host]
    assert not given["https://example.org"] and not given["http://[2001:db8::1]"]
    # each range of addresses in each spelling
    for i, first in enumerate(derived._FIRST_OCTETS):
        ends = [ipaddress.ip_address(f"{first}.{b}.{u}.{i}") for u, b in enumerate(derived._SECOND_OCTETS)]
        private = sum(any(x in ipaddress.ip_network(n) for n in ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16")) for x in ends)
        for form in spellings:
            assert sum(unsafe for _, event, f, unsafe in found if event == i and f == form) == private
