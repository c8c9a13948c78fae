"""Fill-in-the-middle texts against a plain Python version."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from auditloom.llm import fill_middle

SCHEMA = "doc_id long, text string, units string, n string, draws string, form string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "u", "n", "d", "f") for i, t in rows], SCHEMA)


def plain_version(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if text == "" or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", "\n", "a", "a\nb\nc", "a\nb\n", "\n\n\n", "<P", "a <S> b\nc", "<M", "x<\nP>\n<S\n>", "é\n日本😀\r\n\x00z\n", "<<\n>>\n<P\n>", "word " * 20, "l\n" * 500]
ROWS = [(i * len(TEXTS) + j, t) for i in range(12) for j, t in enumerate(TEXTS)] + [(None, "a\nb\nc"), (3, "a\nb"), (3, "a\nb"), (-5, "q\nr\ns\n")]


@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 0), (0, 50), (100, 100)])
def test_rearranged_equals_plain_version(spark, rate, spm):
    got = fill_middle.rearranged(docs(spark, ROWS), rate=rate, suffix_first=spm).withColumn("back", fill_middle.restored()).collect()
    want = [plain_version(i, t, rate=rate, spm=spm) for i, t in ROWS]
    shape = [(r["doc_id"], r["n"], r["form"], r["prefix"] if r["prefix"] is None else len(r["prefix"]), r["middle"] if r["middle"] is None else len(r["middle"]), r["output"]) for r in got]
    assert sorted(shape, key=repr) == sorted(want, key=repr)
    assert all(r["back"] == r["text"] for r in got)


def test_query_columns(spark):
    got = fill_middle.fill_in_middle(docs(spark, ROWS)).collect()
    want = []
    for i, t in ROWS:
        _, n, form, p, m, out = plain_version(i, t)
        want.append((i, n, form, p, m, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    forms = {r["form"] for r in got}
    assert forms == {"plain", "psm", "spm"}


def test_very_long_lines_and_empty_table(spark):
    long = [(1, "x" * 3_000_000), (2, "line of words\n" * 200_000), (3, "é" * 1_000_000 + "\n" + "y" * 1_000_000)]
    got = fill_middle.fill_in_middle(docs(spark, long)).collect()
    for r in got:
        _, n, form, p, m, out = plain_version(*long[r["doc_id"] - 1])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"]) == (n, form, p, m, hashlib.sha256(out.encode()).hexdigest())
    assert fill_middle.fill_in_middle(docs(spark, [])).collect() == []


def test_other_units(spark):
    got = fill_middle.rearranged(docs(spark, [(i, "one two  three") for i in range(20)]), unit=r"\S+\s*|\s+", seed=3).withColumn("back", fill_middle.restored()).collect()
    assert {r["n"] for r in got} == {3} and all(r["back"] == r["text"] for r in got)
    assert {r["prefix"] for r in got} <= {"", "one ", "one two  ", "one two  three"}


def test_no_python_in_the_plan(spark):
    plan = fill_middle.fill_in_middle(docs(spark, ROWS).where(F.col("doc_id") > 0))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
