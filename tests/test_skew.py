"""Joins with frequent keys: same rows as a plain join, and no task with all rows of one key."""

from statistics import median

from pyspark.sql import functions as F

from auditloom.operators import enrich, skew


def links(spark, n=20_000):
    """A home page linked from half of all links, other targets, and links without one."""
    i = F.col("id")
    href = F.when(i % 2 == 0, "/home").when(i % 101 == 1, None).otherwise(F.concat(F.lit("/"), (i % 977).cast("string")))
    columns = {"source_url": F.concat(F.lit("/p"), (i % 500).cast("string")), "anchor_text": F.lit(None).cast("string"), "type": F.lit("internal"), "rel": F.array().cast("array<string>"), "target_status_code": F.lit(None).cast("int"), "is_redirect": F.lit(None).cast("boolean"), "is_broken": F.lit(None).cast("boolean")}
    return spark.range(0, n, 1, 8).select(F.lit("a").alias("audit_id"), href.alias("href"), *[c.alias(k) for k, c in columns.items()])


def pages(spark):
    rows = [("a", "/home", 200, "2xx")] + [("a", f"/{k}", 404 if k % 3 else 301, "4xx" if k % 3 else "3xx") for k in range(0, 977, 2)]
    return spark.createDataFrame(rows, "audit_id string, url string, status_code int, status_class string")


def test_frequent_keys_are_few(spark):
    assert [r["href"] for r in skew.frequent(links(spark), ["audit_id", "href"]).collect()] == ["/home"]
    assert skew.frequent(links(spark, 900), ["href"]).collect() == []


def test_join_equals_a_plain_one(spark):
    rows, table = links(spark), pages(spark).select("audit_id", F.col("url").alias("href"), "status_code")
    plain = rows.join(table, ["audit_id", "href"], "left").groupBy("href", "status_code").count()
    assert sorted(map(tuple, skew.left_join(rows, table, ["audit_id", "href"]).groupBy("href", "status_code").count().collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_no_task_has_all_links_to_the_home_page(spark):
    found = enrich.resolve_links(links(spark), pages(spark))
    by_task = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    home = [r["count"] for r in found.where("href = '/home'").groupBy(F.spark_partition_id()).count().collect()]
    assert max(by_task) <= 4 * median(by_task) and len(home) == 8 and sum(home) == 10_000
    assert {r["target_status_code"] for r in found.where("href = '/home'").select("target_status_code").distinct().collect()} == {200}
    assert found.count() == 20_000 and found.where("is_broken").count() > 0


def test_merge_of_checks_with_a_frequent_target(spark):
    rows = links(spark).withColumn("is_broken", F.lit(True)).withColumn("target_status_code", F.lit(500))
    results = spark.createDataFrame([("/home", 200), ("/3", 503), ("/5", None)], "href string, status int")
    merged = {(r["href"], r["target_status_code"], r["is_broken"]) for r in enrich.merge_verified(rows, results).where("href in ('/home', '/3', '/5', '/7')").distinct().collect()}
    assert merged == {("/home", 200, False), ("/3", 503, True), ("/5", 500, True), ("/7", 500, True)}
