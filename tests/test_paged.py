"""Pages from stored findings against the sorted form."""

import pytest
from pyspark.sql import functions as F

from auditloom.plans import paged, read_api
from auditloom.schemas import FINDINGS, SEVERITIES


def findings(spark, n, hot=0):
    i = F.col("id")
    rule = F.concat(F.lit("r."), (i * 7919 % 11).cast("string"))
    severity = F.element_at(F.array(*map(F.lit, SEVERITIES)), (i * 7919 % 11 % 5 + 1).cast("int"))
    url = F.when(i % 97 == 0, None).when(i < hot, "/same").otherwise(F.concat(F.lit("/"), (i * 104729 % n).cast("string")))
    return spark.range(n).select(F.lit("a").alias("audit_id"), rule.alias("rule_id"), severity.alias("severity"), url.alias("url"), F.concat(F.lit('{"i":'), i.cast("string"), F.lit("}")).alias("detail"))


def test_deep_page_reads_two_files_at_most(spark, tmp_path):
    rows = findings(spark, 150_000)
    paged.store(rows, str(tmp_path / "f"), file_rows=9000)
    pages = paged.Pages(spark, str(tmp_path / "f"))
    page, total = pages.page(limit=200, offset=100_000)
    want = read_api.in_order(rows).offset(100_000).limit(200)
    assert total == 150_000 and len(page.inputFiles()) <= 2
    assert [tuple(r) for r in page.collect()] == [tuple(r) for r in want.collect()]


@pytest.mark.parametrize("given", [{}, {"severity": "low"}, {"rule_id": "r.3"}, {"severity": "high", "rule_id": "r.3"}, {"severity": "none"}])
def test_every_page_equals_the_sorted_form(spark, tmp_path, given):
    rows = findings(spark, 2500, hot=900)
    paged.store(rows, str(tmp_path / "f"), file_rows=300)
    pages = paged.Pages(spark, str(tmp_path / "f"))
    want = [tuple(r) for r in read_api.in_order(read_api.matching(rows, **given)).collect()]
    for offset in (0, 1, 199, 457, len(want) - 3, len(want), 10_000):
        page, total = pages.page(**given, limit=200, offset=offset)
        assert total == len(want) and [tuple(r) for r in page.collect()] == want[max(0, offset) : max(0, offset) + 200]


def test_nothing_stored(spark, tmp_path):
    paged.store(spark.createDataFrame([], FINDINGS), str(tmp_path / "f"))
    page, total = paged.Pages(spark, str(tmp_path / "f")).page()
    assert (page.collect(), total) == ([], 0)
