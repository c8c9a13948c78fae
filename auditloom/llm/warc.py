"""WARC records in ZIP-packaged archives, written and read back by Spark tasks.

Each task writes archives with two stored members: gzipped records one by one,
and an index of (record id, offset, length).  Readers parse the directories,
range-read the index, and then range-read single records; nothing is extracted.

Of records with equal payloads of at least 100 bytes the one with the smallest
page id is a response, the others revisit it.

Defined cases: null html is an empty payload, always a response; a null url is
left out of the record; a payload of any length is one record, read and written
whole; rows that repeat both id and payload of a response (a tie) are responses too;
rows with null id revisit a response that has an id, and are responses where none
has; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import zipfmt
from .runtime import materialize, partitions_for, scratch

LEAST_BYTES = 100
RECORDS_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
#: An archive is closed once it holds so many records or bytes.
ARCHIVE_RECORDS, ARCHIVE_BYTES = 100_000, 1 << 30
#: Neighbouring records that one task reads; payload bytes in one batch of them (one longer payload is a batch of its own).
RUN_RECORDS, BATCH_BYTES = 2_000, 8 << 20
_DATE = "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:page:"


def file_system(uri: str):
    """pyarrow's file system for a folder in Hadoop notation, and the path in it."""
    from pyarrow import fs

    for scheme in ("s3a://", "s3n://"):
        uri = uri.replace(scheme, "s3://", 1) if uri.startswith(scheme) else uri
    return fs.FileSystem.from_uri(uri)


def _urn(page_id: int | None) -> str:
    return f"<{_URN}{'' if page_id is None else page_id}>"


def record(page_id, url, html: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record, gzipped as a member of its own."""
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + html
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {_PROFILE}", f"WARC-Payload-Length: {len(html)}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(packed: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (by lower-case name) and payload of one packed record."""
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def with_targets(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to: which record revisits which."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), html.alias("html")).withColumn("digest", F.sha2("html", 256))
    long = rows.where(F.octet_length("html") >= LEAST_BYTES)
    repeated = long.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # one plan at every size: pages are always dealt out by digest
    joined = rows.join(materialize(repeated.select("digest", "first_id"), "repeated").hint("merge"), "digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "html", "digest", F.when(again, F.col("first_id")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write the records; returns archive, bytes, records - one row per archive that counts.

    A task that runs twice writes under new names; only archives that the returned
    rows name are read, so what a lost attempt left does no harm.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        store.create_dir(base, recursive=True)
        current = None
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*[c.to_pylist() for c in (batch.column(0), batch.column(1), pc.cast(batch.column(2), pa.binary() if pa.types.is_string(batch.column(2).type) else pa.large_binary()), batch.column(3), batch.column(4))], strict=True):
                if current is None:
                    name = f"pages-{uuid.uuid4().hex}.wacz"
                    out = store.open_output_stream(f"{base}/{name}")
                    current = (name, out, zipfmt.StoredZipWriter(out), [])
                    current[2].begin(RECORDS_MEMBER)
                packed = record(page_id, url, html, digest, refers_to)
                position = current[2].write(packed)
                current[3].append((page_id, position, len(packed)))
                if len(current[3]) >= ARCHIVE_RECORDS or current[2].at >= ARCHIVE_BYTES:
                    yield _closed(current)
                    current = None
        if current is not None:
            yield _closed(current)

    return rows.mapInArrow(write, "archive string, bytes long, records long")


def _closed(current) -> pa.RecordBatch:
    name, out, archive, index = current
    archive.end()
    archive.begin(INDEX_MEMBER)
    for page_id, position, length in index:
        archive.write((json.dumps({"id": page_id, "offset": position, "length": length}) + "\n").encode())
    archive.end()
    size = archive.close()
    out.close()
    return pa.RecordBatch.from_pydict({"archive": [name], "bytes": [size], "records": [len(index)]})


def read_index(archives: DataFrame, folder: str) -> DataFrame:
    """archive, run, offset, length of every record, from the archives' directories and indexes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{name}") as source:
                    members = {m.name: m for m in zipfmt.directory(source, size)}
                    start, _ = zipfmt.stored_range(source, members[RECORDS_MEMBER])
                    lines = zipfmt.read_range(source, *zipfmt.stored_range(source, members[INDEX_MEMBER])).splitlines()
                entries = [json.loads(line) for line in lines]
                yield pa.RecordBatch.from_pydict({
                    "archive": pa.array([name] * len(entries), pa.string()),
                    "run": pa.array([i // RUN_RECORDS for i in range(len(entries))], pa.int64()),
                    "offset": pa.array([start + e["offset"] for e in entries], pa.int64()),
                    "length": pa.array([e["length"] for e in entries], pa.int64()),
                })

    return archives.mapInArrow(read, "archive string, run long, offset long, length long")


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Range-read the records of an index: page_id, url, record_type, refers_to, payload (of responses; null if not asked for), payload_bytes, payload_digest."""
    types = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string()}

    def batch_of(out: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({k: pa.array(out[k], types[k]) for k in types})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        name, source = None, None
        for batch in batches:
            out: dict[str, list] = {k: [] for k in types}
            held = 0
            for archive, offset, length in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if archive != name:
                    if source is not None:
                        source.close()
                    name, source = archive, store.open_input_file(f"{base}/{archive}")
                fields, payload = parse(zipfmt.read_range(source, offset, length))
                revisit = fields["warc-type"] == "revisit"
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
                out["page_id"].append(_page(fields["warc-record-id"]))
                out["url"].append(fields.get("warc-target-uri"))
                out["record_type"].append(fields["warc-type"])
                out["refers_to"].append(_page(fields["warc-refers-to"]) if revisit else None)
                out["payload"].append(payload if payloads and not revisit else None)
                out["payload_bytes"].append(int(fields["warc-payload-length"]) if revisit else len(payload))
                out["payload_digest"].append(digest)
                held += len(payload) if payloads else 0
                if held >= BATCH_BYTES:
                    yield batch_of(out)
                    out, held = {k: [] for k in types}, 0
            yield batch_of(out)
        if source is not None:
            source.close()

    return index.mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def _page(urn: str) -> int | None:
    text = urn.strip("<>").removeprefix(_URN)
    return int(text) if text else None


def round_trip(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Write every page as a record, read all archives back: one row per page, with the payload of responses if asked for."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    archives = materialize(write_archives(with_targets(pages), folder), "archives")
    index = materialize(read_index(archives.repartition(partitions_for(spark, archives.count(), 1), "archive"), folder), "index")
    runs = partitions_for(spark, index.count(), 4 * RUN_RECORDS)
    return read_records(index.repartition(runs, "archive", "run").sortWithinPartitions("archive", "offset"), folder, payloads)


def warc(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records read back."""
    return round_trip(pages, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as payload_bytes from pages
), f as (
  select html, min(page_id) as first_id from p where payload_bytes >= 100 group by html having count(*) > 1
)
select p.page_id, p.payload_bytes, sha256(p.html) as payload_digest,
       case when f.first_id is not null and p.page_id is distinct from f.first_id then 'revisit' else 'response' end as record_type,
       case when f.first_id is not null and p.page_id is distinct from f.first_id then f.first_id end as refers_to
from p left join f on p.html = f.html
"""
