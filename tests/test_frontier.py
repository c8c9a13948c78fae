"""The frontier against a queue in memory."""

import random

from auditloom.operators import frontier


def by_queue(links, seeds, most, deepest=None):
    """A crawl one page at a time: (url, depth, place, found_on, crawl_source)."""
    out, seen = [], {}
    for url, rank, source in sorted(seeds, key=lambda s: (s[1], s[2], s[0])):
        seen.setdefault(url, (rank, source))
    queue = [(u, 0, None, s) for u, (r, s) in sorted(seen.items(), key=lambda x: (x[1][0], x[0]))]
    known = set(seen)
    while queue and len(out) < most:
        url, depth, by, source = queue.pop(0)
        out.append((url, depth, len(out), by, source))
        for href, _ in sorted(((h, a) for s, h, a in links if s == url), key=lambda x: (x[1], x[0])):
            if href not in known and (deepest is None or depth < deepest):
                known.add(href)
                queue.append((href, depth + 1, url, "link"))
    return sorted(out, key=lambda r: r[2])


def visited(spark, links, seeds, most, deepest=None):
    edges = spark.createDataFrame(links, "source_url string, href string, at long")
    start = spark.createDataFrame(seeds, "url string, rank long, crawl_source string")
    return sorted((tuple(r) for r in frontier.visits(edges, start, most, deepest).select("url", "depth", "place", "found_on", "crawl_source").collect()), key=lambda r: r[2])


def web(pages, fan, seed):
    rng = random.Random(seed)
    return [(f"/{p}", f"/{rng.randrange(pages)}", at) for p in range(pages) for at in range(rng.randrange(fan))]


def test_visits_equal_a_queue(spark):
    links = web(120, 5, 3) + [("/7", "/7", 0), ("/7", "/out", 1), ("/7", "/out", 2)] + [(f"/{p}", "/home", 9) for p in range(120)]
    seeds = [("/7", 0, "link"), ("/90", 2, "sitemap"), ("/7", 1, "sitemap"), ("/91", 2, "sitemap")]
    for most in (1 << 40, 40, 3, 2):
        assert visited(spark, links, seeds, most) == by_queue(links, seeds, most)


def test_depth_limit_chains_and_nothing_to_visit(spark):
    chain = [(f"/{i}", f"/{i + 1}", 0) for i in range(12)]
    assert visited(spark, chain, [("/0", 0, "link")], 1000) == by_queue(chain, [("/0", 0, "link")], 1000)
    assert [r[0] for r in visited(spark, chain, [("/0", 0, "link")], 1000, 3)] == ["/0", "/1", "/2", "/3"]
    assert visited(spark, chain, [], 10) == [] and [r[0] for r in visited(spark, [], [("/x", 0, "link")], 10)] == ["/x"]
