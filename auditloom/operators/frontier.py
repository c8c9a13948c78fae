"""A crawl's frontier over links that are known already: which pages it would visit, how deep, in which order.

Level by level, each level a join of the last one with the links.  A page counts as
found by the first link in crawl order: pages in the order in which they were found
themselves, the links of a page by their place in it.  A target that many links name
is reduced by partial minima, so it is no hot group; the numbers within a level come
from range partitions that are counted one by one and then shifted.  The last level
is cut where the budget of pages ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Step, numbered

MOST_PAGES = 500


def visits(links: DataFrame, seeds: DataFrame, most: int = MOST_PAGES, deepest: int | None = None) -> DataFrame:
    """url, depth, place, found_on, crawl_source of the pages visited: ``seeds`` (url, rank, crawl_source) at depth 0, then level by level along ``links`` (source_url, href, at: the place of a link in its page), at most ``most`` pages and ``deepest`` levels."""
    first = seeds.groupBy("url").agg(F.min(F.struct("rank", "crawl_source")).alias("s")).select("url", F.lit(None).cast("string").alias("found_on"), F.col("s.crawl_source").alias("crawl_source"), F.col("s.rank").alias("rank"))
    steps: list[Step] = []
    placed, _ = numbered(first, "rank", "url")
    seen = level = placed.df.where(F.col("place") < most).select("url", F.lit(0).alias("depth"), "place", "found_on", "crawl_source")
    steps.append(Step(level, "level"))
    placed.drop()
    seen = level = steps[0].df
    total, depth = level.count(), 0
    edges = links.select("source_url", "href", "at")
    while total < most and (deepest is None or depth < deepest):
        reached = level.select(F.col("url").alias("source_url"), "place").join(edges, "source_url").groupBy(F.col("href").alias("url")).agg(F.min(F.struct("place", "at", "source_url")).alias("by"))
        fresh = reached.join(seen.select("url"), "url", "left_anti").select("url", F.col("by.place").alias("by_place"), F.col("by.at").alias("by_at"), F.col("by.source_url").alias("found_on"))
        placed, n = numbered(fresh, "by_place", "by_at", "url", start=total)
        if not n:
            placed.drop()
            break
        depth += 1
        level = placed.df.where(F.col("place") < most).select("url", F.lit(depth).alias("depth"), "place", "found_on", F.lit("link").alias("crawl_source"))
        steps.append(Step(level, "level"))
        placed.drop()
        level = steps[-1].df
        seen = seen.unionByName(level)
        total += min(n, most - total)
    return seen


def site_links(links: DataFrame) -> DataFrame:
    """The links that a crawl follows: internal ones, numbered by their place in the links of each page (audit_id left aside)."""
    return links.where("type = 'internal'").select("source_url", "href", "at").groupBy("source_url", "href").agg(F.min("at").alias("at"))
