"""Workbooks put together from parts that tasks have deflated, against those written row by row."""

import datetime as dt
import io
import json
import random
import re
import zipfile
import zlib

from auditloom import schemas
from auditloom.plans import report
from auditloom.plans.read_api import in_order
from auditloom.sources import zipparts

WHEN = dt.datetime(2024, 5, 6, 7, 8, 9)


def test_checksums_combine():
    rng = random.Random(1)
    for sizes in ((0, 0), (0, 5), (5, 0), (1, 1), (1000, 77), (70_000, 65_536)):
        a, b = (rng.randbytes(n) for n in sizes)
        assert zipparts.combined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_archive_of_parts():
    out = io.BytesIO()
    archive = zipparts.Archive(out)
    texts = [b"first " * 1000, b"", b"second"]
    archive.member("a/b.xml", [zipparts.deflated(t) for t in texts] + [zipparts.deflated(b"end", last=True)])
    archive.member("é.txt", [zipparts.deflated(b"alone", last=True)])
    archive.close()
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:
        assert z.testzip() is None and z.read("a/b.xml") == b"".join(texts) + b"end" and z.read("é.txt") == b"alone"


def findings(spark, n):
    rng, rows = random.Random(3), []
    rules = [r for s in report.SHEETS for r in s.rules if s.name != "Hreflang"] + ["own.rule"]
    for i in range(n):
        detail = {"href": f"/h{i % 5}", "targetStatusCode": rng.choice([404, 500, None, "x"]), "title": rng.choice(["<a & b>", "é\x01", ""]), "duplicateCount": i / 3, "variants": ["b", "", "c"], "isLoop": rng.choice([True, False]), "cls": 0.25, "issues": "a, b"}
        rows.append(("x", rng.choice(rules), rng.choice(schemas.SEVERITIES), rng.choice([None, f"/{i % 40}"]), json.dumps(detail)))
    return spark.createDataFrame(rows, schemas.FINDINGS)


def sheets_of(path):
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        names = re.findall('<sheet name="([^"]*)"', z.read("xl/workbook.xml").decode())
        return {n: z.read(f"xl/worksheets/sheet{i}.xml").decode() for i, n in enumerate(names, 1)}


def test_parts_equal_rows(spark, tmp_path):
    found = findings(spark, 900)
    audit = {"id": "x", "start_url": "https://e.test", "status": "done"}
    got = sheets_of(report.build_workbook(found, audit, str(tmp_path), WHEN, most_rows=41))
    ordered = in_order(found)
    plain = [("Summary", ["Field", "Value", "Count"], report.summary_rows(found, audit, WHEN))]
    plain += [(s.name, s.headers(), map(tuple, s.rows(ordered).collect())) for s in report.SHEETS]
    plain.append((report.OTHER, ["Severity", "Rule ID", "URL", "Detail"], map(tuple, report.other(ordered).collect())))
    report.write_workbook(str(tmp_path / "plain.xlsx"), plain, most_rows=41)
    want = sheets_of(str(tmp_path / "plain.xlsx"))
    assert list(got) == list(want) and "Titles (2)" in got and "Hreflang" in got
    assert got == want


def test_parts_within_a_sheet(spark):
    found = findings(spark, 300)
    parts = report.sheet_parts(found, part_rows=7).collect()
    assert len(parts) > 40 and max(p["size"] for p in parts) < 20_000
    by = {}
    for p in sorted(parts, key=lambda p: (p["section"], p["sheet"], p["chunk"])):
        unpacked = zlib.decompressobj(-15).decompress(bytes(p["data"]))
        assert len(unpacked) == p["size"] and zlib.crc32(unpacked) == p["crc"]
        by.setdefault(p["section"], []).extend(map(int, re.findall(rb'<row r="(\d+)"', unpacked)))
    assert all(rows == list(range(2, 2 + len(rows))) for rows in by.values()) and sum(map(len, by.values())) == 300


def test_no_findings(spark, tmp_path):
    got = sheets_of(report.build_workbook(spark.createDataFrame([], schemas.FINDINGS), {"id": "x", "start_url": "u", "status": "done"}, str(tmp_path), WHEN))
    assert len(got) == 1 + len(report.SHEETS) and report.OTHER not in got and all(x.count("<row ") == 1 for n, x in got.items() if n != "Summary")
