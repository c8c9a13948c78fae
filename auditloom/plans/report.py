"""Report: one sheet per category as projections of findings, a summary, a catch-all, and the workbook."""

from __future__ import annotations

import datetime as dt
import itertools
import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SEVERITIES, severity_rank
from ..ship import ship
from ..sources.shared import Step, numbered
from ..sources.zipparts import Archive, Part, deflated
from . import engine

SITE_WIDE = "(site-wide)"
OTHER = "Other"

_key = lambda name: F.get_json_object("detail", f"$.{name}")
_tail = lambda: F.element_at(F.split("rule_id", r"\."), -1)


def text(name: str) -> Column:
    """A detail as text; empty is null."""
    return F.nullif(_key(name), F.lit(""))


def number(name: str) -> Column:
    """A detail as a finite number, else null."""
    value = _key(name).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def flag(name: str) -> Column:
    return _key(name).cast("boolean")


def joined(name: str) -> Column:
    """An array, or a comma-separated text, as text joined by ', ' without empty parts."""
    raw = _key(name)
    parts = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.transform(F.split(raw, ","), lambda s: F.trim(s)))
    return F.nullif(F.array_join(F.filter(parts, lambda s: s != ""), ", "), F.lit(""))


@dataclass(frozen=True)
class Sheet:
    """A report sheet: its rules, and its columns after severity and url (header, key, expression)."""

    name: str
    rules: tuple[str, ...]
    columns: tuple[tuple[str, str, Callable[[], Column]], ...]
    advice: Callable[[], Column] | None = None

    def cells(self) -> list[Column]:
        """The sheet's columns; what has none of its own is in ``details`` (JSON)."""
        extra = {"recommendation": self.advice()} if self.advice and all(k != "recommendation" for _, k, _ in self.columns) else {}
        if self.name == "Performance":
            extra = {"metric": _tail()}
        details = F.to_json(F.struct(*[v.alias(k) for k, v in sorted(extra.items())])) if extra else F.lit(None).cast("string")
        return [F.col("severity"), F.coalesce("url", F.lit(SITE_WIDE)).alias("url"), *[make().alias(k) for _, k, make in self.columns], details.alias("details")]

    def rows(self, findings: DataFrame) -> DataFrame:
        """The sheet's rows."""
        return findings.where(F.col("rule_id").isin(*self.rules)).select(*self.cells())

    def headers(self) -> list[str]:
        return ["Severity", "Page", *[h for h, _, _ in self.columns], "Details"]


def _const(words: str) -> Callable[[], Column]:
    return lambda: F.lit(words)


def _by_rule(**words: str) -> Callable[[], Column]:
    """Advice by the last part of the rule id; ``other`` for the rest."""

    def make() -> Column:
        out = F.lit(words["other"])
        for tail, advice in words.items():
            out = F.when(_tail() == tail.replace("_", "-"), advice).otherwise(out) if tail != "other" else out
        return out

    return make


def _element(sheet: str, name: str, key: str, header: str, advice: dict[str, str]) -> Sheet:
    value = lambda: F.when(_tail() == "multiple", joined(f"{key}s")).otherwise(text(key))
    count = lambda: F.when(_tail() == "duplicate", number("duplicateCount")).otherwise(number("count"))
    return Sheet(sheet, tuple(f"meta.{name}.{k}" for k in ("missing", "duplicate", "multiple")), (("Issue", "issue", _tail), (header, key, value), ("Count", "count", count)), _by_rule(**advice))


_t, _n, _j = (lambda f: lambda name: (lambda: f(name)))(text), (lambda f: lambda name: (lambda: f(name)))(number), (lambda f: lambda name: (lambda: f(name)))(joined)

# Sheet names, headers and advice (fixed values of the report).
SHEETS = (
    Sheet(
        "Redirects", ("links.internal-redirect", "links.redirect-chain"),
        (("Link href", "href", _t("href")), ("Target status", "targetStatusCode", _n("targetStatusCode")), ("Hops", "hops", _n("hops")), ("Loop?", "isLoop", lambda: flag("isLoop")),
         ("Recommendation", "recommendation", _by_rule(redirect_chain="Collapse the redirect chain; link directly to the final URL", other="Point link to final URL (avoid the 3xx hop)"))),
    ),
    Sheet(
        "Broken Links", ("links.broken-internal", "links.broken-external"),
        (("Link href", "href", _t("href")), ("Target status", "targetStatusCode", _n("targetStatusCode")), ("Link type", "linkType", lambda: F.regexp_replace(_tail(), "^broken-", ""))),
        _const("Remove or fix link"),
    ),
    Sheet("External Links", ("links.external-flag",), (("Link href", "href", _t("href")), ("rel", "rel", _j("rel")))),
    _element("Titles", "title", "title", "Title", {"missing": "Add a unique <title>", "duplicate": "Make the title unique per page", "other": "Keep a single <title>"}),
    _element("Descriptions", "description", "description", "Description", {"missing": "Add a meta description", "duplicate": "Make the description unique per page", "other": "Keep a single meta description"}),
    _element("H1", "h1", "h1", "H1", {"missing": "Add a single <h1>", "duplicate": "Make the H1 unique per page", "other": "Keep a single <h1>"}),
    Sheet("Duplicate Pages", ("dupe.content",), (("Content hash", "contentHash", _t("contentHash")), ("Group size", "duplicateCount", _n("duplicateCount"))), _const("Canonicalize duplicates to one URL")),
    Sheet(
        "Indexation", ("index.canonical", "index.robots"),
        (("Issue", "issue", lambda: F.when(_tail() == "robots", "noindex/blocked").otherwise(text("issue"))), ("Canonical URL", "canonicalUrl", _t("canonicalUrl")), ("Robots reason", "reason", _j("reason"))),
        _by_rule(robots="Remove the noindex/robots block if the page should rank", other="Set a self-referential canonical"),
    ),
    Sheet("URL Heuristics", ("index.url-heuristics",), (("Issues", "issues", _j("issues")),), _const("Use lowercase, hyphenated, short, param-free URLs")),
    Sheet("Pagination", ("pagination.rel",), (("rel=next", "relNext", _t("relNext")), ("Issue", "issue", _t("issue"))), _const("Fix rel=next/prev reciprocity across the series")),
    Sheet("Hreflang", ("i18n.hreflang",), (("Lang", "lang", _t("lang")), ("href", "href", _t("href")), ("Issue", "issue", _j("issue"))), _const("Add reciprocal return tags and valid BCP-47 lang codes")),
    Sheet(
        "Images", ("image.alt-title", "image.broken"),
        (("Image src", "src", _t("src")), ("Issue", "issue", lambda: F.when(_tail() == "broken", F.concat(F.lit("broken ("), F.coalesce(text("statusCode"), F.lit("?")), F.lit(")"))).otherwise(text("altState"))),
         ("Status", "statusCode", _n("statusCode"))),
        _by_rule(broken="Fix or remove the broken image", other="Add descriptive alt text"),
    ),
    Sheet(
        "Mirrors", ("mirror.main-mirror", "mirror.trailing-slash"),
        (("Issue", "issue", _tail), ("Variant / duplicate-of", "variant", lambda: F.when(_tail() == "main-mirror", joined("variants")).otherwise(text("slashUrl"))), ("Mirror count", "mirrorCount", _n("mirrorCount"))),
        _by_rule(main_mirror="Redirect mirrors to one canonical origin", other="Redirect to a single trailing-slash form"),
    ),
    Sheet(
        "Performance", ("perf.lcp", "perf.cls-inp", "perf.psi-usability", "perf.mobile-indexing"),
        (("Strategy", "strategy", _t("strategy")), ("LCP (ms)", "lcpMs", _n("lcpMs")), ("CLS", "cls", _n("cls")), ("INP (ms)", "inpMs", _n("inpMs")),
         ("Flags", "flags", lambda: F.coalesce(joined("flags"), joined("issues")))),
    ),
    Sheet(
        "Meta Templates", ("meta.title.template", "meta.description.template", "meta.h1.template"),
        (("Element", "element", lambda: F.element_at(F.split("rule_id", r"\."), -2)), ("Current value", "value", lambda: F.coalesce(text("title"), text("description"), text("h1"))),
         ("Length", "length", _n("length")), ("Recommendation", "recommendation", _t("recommendation"))),
    ),
)


def _sections(findings: DataFrame) -> DataFrame:
    rows = [(i, s.name, r) for i, s in enumerate(SHEETS) for r in s.rules]
    return findings.sparkSession.createDataFrame(rows, "place int, section string, rule_id string")


def section_summary(findings: DataFrame) -> DataFrame:
    """place, section, findings, dominant severity of every sheet, and of Other if it has findings."""
    counted = findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.min(severity_rank(F.col("severity"))).alias("rank"))
    joined_rows = _sections(findings).join(counted, "rule_id", "full")
    grouped = joined_rows.groupBy(F.coalesce("place", F.lit(len(SHEETS))).alias("place"), F.coalesce("section", F.lit(OTHER)).alias("section"))
    grouped = grouped.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("findings"), F.min("rank").alias("rank"))
    return grouped.select("place", "section", "findings", F.get(F.array(*map(F.lit, SEVERITIES)), F.col("rank")).alias("dominant"))


def other(findings: DataFrame) -> DataFrame:
    """Findings of rules that no sheet covers, details with sorted keys."""
    rest = findings.join(_sections(findings).select("rule_id"), "rule_id", "left_anti")
    return rest.select("severity", "rule_id", "url", sorted_json(F.col("detail")).alias("detail"))


def sorted_json(detail: Column) -> Column:
    """JSON objects with their keys in order (variants keep object keys sorted)."""
    return F.to_json(F.parse_json(detail))


def summary_rows(findings: DataFrame, audit: dict, generated: dt.datetime) -> list[tuple]:
    """Rows (field, value, count) of the summary sheet."""
    severities = {r["severity"]: r["findings"] for r in engine.by_severity(findings).collect()}
    head = [("Start URL", audit["start_url"], None), ("Audit ID", audit["id"], None), ("Status", audit["status"], None), ("Generated at", generated.strftime("%Y-%m-%dT%H:%M:%S.000Z"), None), ("Total findings", "", sum(severities.values()))]
    middle = [("", "", None), ("Severity", "Findings by severity", None), *[(s, "", severities[s]) for s in SEVERITIES], ("", "", None), ("Category", "Findings by category (dominant severity)", None)]
    return head + middle + [(r["section"], r["dominant"] or "", r["findings"]) for r in section_summary(findings).orderBy("place").collect()]


# --- workbook ------------------------------------------------------------------

#: Rows of one worksheet with its header, and characters of one cell, as the format allows them; what goes beyond the rows is in further sheets, longer text is cut.
MOST_ROWS, MOST_CHARACTERS = 1_048_576, 32_767
_FILLS = {"critical": "FFF4CCCC", "high": "FFFCE5CD", "medium": "FFFFF2CC", "low": "FFD9EAD3", "info": "FFCFE2F3"}


def file_name(audit_id: str, generated: dt.datetime) -> str:
    return f"audit-{audit_id}-{generated.strftime('%Y%m%d-%H%M%S')}.xlsx"


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(ref: str, value, style: int) -> str:
    if value is None or value == "":
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" s="{style}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f'<c r="{ref}" s="{style}"><v>{int(value) if value == int(value) else repr(value)}</v></c>'
    clean = "".join(c for c in str(value) if c >= " " or c in "\t\n\r")[:MOST_CHARACTERS]
    return f'<c r="{ref}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'


_NAMESPACE = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_VIEW = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'


def _head(headers: list[str]) -> bytes:
    cells = "".join(_cell(f"{_letters(i)}1", h, 1) for i, h in enumerate(headers))
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NAMESPACE}">{_VIEW}<sheetData><row r="1">{cells}</row>'.encode()


def _line(n: int, row: Sequence, coloured: bool) -> bytes:
    style = 2 + SEVERITIES.index(row[0]) if coloured and row[0] in SEVERITIES else 0
    return (f'<row r="{n}">' + "".join(_cell(f"{_letters(i)}{n}", v, style if i == 0 else 0) for i, v in enumerate(row)) + "</row>").encode("utf-8", "replace")


def _foot(columns: int, last: int) -> bytes:
    return f'</sheetData><autoFilter ref="A1:{_letters(columns - 1)}{last}"/></worksheet>'.encode()


def _part_name(name: str, part: int) -> str:
    return name[:31] if part == 1 else f"{name[:25]} ({part})"


def _from_rows(sheets: Iterable[tuple[str, list[str], Iterable[tuple]]], most: int) -> Iterator[tuple[str, Iterator[Part]]]:
    """Names and parts of worksheets made of rows as they come, each with ``most`` rows at most."""
    for name, headers, rows in sheets:
        rows, part = iter(rows), 1
        first = list(itertools.islice(rows, 1))
        while first or part == 1:
            yield _part_name(name, part), _lines(headers, itertools.chain(first, itertools.islice(rows, most - 1 - len(first))))
            first, part = list(itertools.islice(rows, 1)), part + 1


def _lines(headers: list[str], rows: Iterator[tuple]) -> Iterator[Part]:
    yield deflated(_head(headers))
    last = 1
    while some := list(itertools.islice(rows, PART_ROWS)):
        yield deflated(b"".join(_line(last + n, row, headers[0] == "Severity") for n, row in enumerate(some, start=1)))
        last += len(some)
    yield deflated(_foot(len(headers), last), last=True)


#: Rows that one task turns into one part of a worksheet.
PART_ROWS = 10_000
_OTHER_HEADERS = ["Severity", "Rule ID", "URL", "Detail"]


def sheet_parts(findings: DataFrame, most_rows: int = MOST_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """section, sheet, chunk, last (row), crc, size, data: worksheets of all findings in parts, numbered, written as XML and deflated by tasks."""
    sections = [(s.rules, F.to_json(F.array(*[_as_json(c) for c in s.cells()]))) for s in SHEETS]
    section, cells = F.lit(len(SHEETS)), F.to_json(F.array(*map(_as_json, (F.col("severity"), F.col("rule_id"), F.col("url"), sorted_json(F.col("detail"))))))
    for i, (rules, own) in enumerate(sections):
        mine = F.col("rule_id").isin(*rules)
        section, cells = F.when(mine, i).otherwise(section), F.when(mine, own).otherwise(cells)
    rows = findings.select(section.alias("section"), severity_rank(F.col("severity")).alias("rank"), "rule_id", F.col("url").isNull().alias("last_ones"), "url", "detail", cells.alias("cells"))
    placed, _ = numbered(rows, "section", "rank", "rule_id", "last_ones", "url", "detail")
    counts = {r["section"]: r["count"] for r in placed.df.groupBy("section").count().collect()}  # one row for each sheet
    start, before = F.lit(0), 0
    for i in sorted(counts):
        start, before = F.when(F.col("section") == i, before).otherwise(start), before + counts[i]
    n = F.col("place") - start
    rows = placed.df.select("section", F.floor(n / (most_rows - 1)).alias("sheet"), (n % (most_rows - 1) + 2).alias("row"), "cells")
    rows = rows.withColumn("chunk", F.floor(F.col("row") / part_rows))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lines, last = None, [], 0
        for batch in batches:
            for *own, row, cells in zip(*(batch.column(c).to_pylist() for c in ("section", "sheet", "chunk", "row", "cells")), strict=True):
                if own != key and lines:
                    yield _made(key, last, lines)
                    lines = []
                key, last = own, row
                lines.append(_line(row, [json.loads(c) for c in json.loads(cells)], True))
        if lines:
            yield _made(key, last, lines)

    keys = ["section", "sheet", "chunk"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "row")  # at most part_rows rows for each key
    return Step(dealt.mapInArrow(write, "section int, sheet long, chunk long, last long, crc long, size long, data binary"), "sheets").df


def _as_json(cell: Column) -> Column:
    """A cell as JSON of its own, so that cells of several types stand in one array."""
    whole = F.to_json(F.struct(cell.alias("c")), {"ignoreNullFields": "false"})  # {"c":...}
    return F.substr(whole, F.lit(6), F.char_length(whole) - 6)


def _made(key: list, last: int, lines: list[bytes]) -> pa.RecordBatch:
    part = deflated(b"".join(lines))
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*key, last, part.crc, part.size, part.data), kinds, strict=True)], ["section", "sheet", "chunk", "last", "crc", "size", "data"])


def _from_parts(parts: DataFrame) -> Iterator[tuple[str, Iterator[Part]]]:
    """Names and parts of worksheets that tasks have made; a sheet without rows has its header only."""
    rows = itertools.groupby(parts.orderBy("section", "sheet", "chunk").toLocalIterator(), key=lambda r: (r["section"], r["sheet"]))
    found = next(rows, None)
    for i in range(len(SHEETS) + 1):
        name, headers = (SHEETS[i].name, SHEETS[i].headers()) if i < len(SHEETS) else (OTHER, _OTHER_HEADERS)
        part = 1
        while (found and found[0][0] == i) or (part == 1 and i < len(SHEETS)):
            mine = found[1] if found and found[0][0] == i else ()
            yield _part_name(name, part), _whole(headers, mine)
            if found and found[0][0] == i:
                found = next(rows, None)
            part += 1


def _whole(headers: list[str], rows: Iterable) -> Iterator[Part]:
    last = 1
    yield deflated(_head(headers))
    for r in rows:
        last = r["last"]
        yield Part(bytes(r["data"]), r["crc"], r["size"])
    yield deflated(_foot(len(headers), last), last=True)


def write_workbook(path: str, sheets: Iterable[tuple[str, list[str], Iterable[tuple]]], most_rows: int = MOST_ROWS) -> None:
    """An .xlsx file of sheets (name, headers, rows): header band, frozen first row, filters, severities in colour."""
    _write(path, _from_rows(sheets, most_rows))


def _write(path: str, sheets: Iterable[tuple[str, Iterator[Part]]]) -> None:
    main = _NAMESPACE
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="{c}"/></patternFill></fill>' for c in ("FFD9D9D9", *(_FILLS[s] for s in SEVERITIES)))
    formats = "".join(f'<xf fontId="{int(i == 1)}" fillId="{i + 1 if i else 0}" borderId="0" applyFill="1" applyFont="1"/>' for i in range(7))
    styles = f'<styleSheet xmlns="{main}"><fonts count="2"><font/><font><b/></font></fonts><fills count="8"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="7">{formats}</cellXfs></styleSheet>'
    part = f"{package}/content-types"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with open(path, "wb") as out:
        z, names = Archive(out), []
        for name, parts in sheets:
            names.append(name)
            z.member(f"xl/worksheets/sheet{len(names)}.xml", parts)
        n = len(names)
        for name, content in (
            ("[Content_Types].xml", f'<Types xmlns="{part}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(n)) + "</Types>"),
            ("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>'),
            ("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(name)}" sheetId="{i + 1}" r:id="r{i + 1}"/>' for i, name in enumerate(names)) + "</sheets></workbook>"),
            ("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{i + 1}" Type="{office}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(n)) + f'<Relationship Id="r{n + 1}" Type="{office}/styles" Target="styles.xml"/></Relationships>'),
            ("xl/styles.xml", styles),
        ):
            z.member(name, [deflated(content.encode(), last=True)])
        z.close()


def build_workbook(findings: DataFrame, audit: dict, folder: str, generated: dt.datetime, most_rows: int = MOST_ROWS) -> str:
    """Write an audit's report; returns its path.  Tasks write and deflate the rows; the driver puts their parts together as they come, and holds one partition of parts."""
    ship(findings.sparkSession)
    parts = sheet_parts(findings, most_rows)
    path = f"{folder}/{file_name(audit['id'], generated)}"
    summary = _from_rows([("Summary", ["Field", "Value", "Count"], summary_rows(findings, audit, generated))], most_rows)
    _write(path, itertools.chain(summary, _from_parts(parts)))
    return path
