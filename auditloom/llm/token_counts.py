"""Token counts from flat token files that have no index.

A token file is a run of 16-bit ids in which an end-of-document id follows every
text.  Blocks of the files are searched for that id with one vectorised
comparison each; a prefix scan over a file's blocks then tells every separator its
ordinal and the separator before it, also across block boundaries.

Defined cases: null and empty texts have 0 tokens; texts of any length are counted
whole, also across blocks; repeated rows are counted each by itself, so there are no
ties; the strings of special tokens in a text are ordinary text, so no text can hold
a separator; a vocabulary with ids beyond 16 bits is refused (ValueError); an empty
table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .runtime import Stored, list_column, materialize, remove, scratch, slices
from .warc import file_system

END_OF_DOCUMENT = 50256
#: Files hold 16-bit ids.
MOST_ID = (1 << 16) - 1
#: A file is closed beyond so many bytes; blocks are searched by one task each.
FILE_BYTES, BLOCK_BYTES = 256 << 20, 8 << 20


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_OF_DOCUMENT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write flat token files; returns file, ordinal, doc_id, bytes: which text is the n-th of a file (bytes: on the last row of each)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        store.create_dir(base, recursive=True)
        encode = tokens.encoder(tokenizer, special_as_text=True)
        name, out, size, ordinal = None, None, 0, 0
        for whole in batches:
            for part in slices(whole, "text"):
                if name is None:
                    name, size, ordinal = f"tokens-{uuid.uuid4().hex}.u16", 0, 0
                    out = store.open_output_stream(f"{base}/{name}")
                ids, counts = encode.batch(part.column(1))
                if len(ids) and ids.max() > MOST_ID:
                    raise ValueError(f"token id {ids.max()} does not fit a file of 16-bit ids")
                at = np.cumsum(counts)
                flat = np.insert(ids, at, end_id).astype("<u2")
                out.write(flat.tobytes())
                size += flat.nbytes
                n, full = part.num_rows, size >= file_bytes
                yield _rows(name, part.column(0), np.arange(ordinal, ordinal + n), size if full else None)
                ordinal += n
                if full:
                    out.close()
                    name = None
        if name is not None:
            out.close()
            yield _rows(name, pa.nulls(1, pa.int64()), np.array([-1]), size)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(write, "file string, ordinal long, doc_id long, bytes long")


def _rows(name: str, ids: pa.Array, ordinals: np.ndarray, size: int | None) -> pa.RecordBatch:
    """Rows of the list of texts; the last row of a batch that closes its file has the file's size."""
    sizes = [None] * len(ordinals)
    if len(sizes):
        sizes[-1] = size
    return pa.RecordBatch.from_arrays([pa.array([name] * len(ordinals), pa.string()), pa.array(ordinals, pa.int64()), ids, pa.array(sizes, pa.int64())], ["file", "ordinal", "doc_id", "bytes"])


def separators(files: DataFrame, folder: str, end_id: int = END_OF_DOCUMENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, block, n, last, at: positions of the separators of every block (in ids from the file's start)."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(block_bytes).cast("long"))
    blocks = files.where("bytes > 0").select("file", F.posexplode(starts).alias("block", "from_byte"), "bytes")
    blocks = blocks.select("file", F.col("block").cast("long").alias("block"), "from_byte", F.least(F.lit(block_bytes), F.col("bytes") - F.col("from_byte")).cast("long").alias("length"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        for batch in batches:
            for i in range(batch.num_rows):
                name, block, start, length = (batch.column(c)[i].as_py() for c in range(4))
                with store.open_input_file(f"{base}/{name}") as source:
                    ids = np.frombuffer(source.read_at(length, start), dtype="<u2")
                at = np.flatnonzero(ids == end_id) + start // 2
                last = pa.array([int(at[-1]) if len(at) else None], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([len(at)], pa.int64()), last, list_column(at.astype(np.int64), np.array([len(at)]))], ["file", "block", "n", "last", "at"])

    spread = blocks.repartition(blocks.sparkSession.sparkContext.defaultParallelism * 2, "file", "block")
    return spread.mapInArrow(search, "file string, block long, n long, last long, at array<long>")


def stitch(found: DataFrame) -> DataFrame:
    """file, ordinal, n_tokens of every text: the prefix scan over each file's blocks."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.withColumns({"base": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "carry": F.coalesce(F.max("last").over(earlier), F.lit(-1))})
    each = scanned.select("file", "base", "carry", "at", F.posexplode("at").alias("i", "position"))
    before = F.when(F.col("i") == 0, F.col("carry")).otherwise(F.get("at", F.col("i") - 1))
    return each.select("file", (F.col("base") + F.col("i")).alias("ordinal"), (F.col("position") - before - 1).alias("n_tokens"))


def token_counts(docs: DataFrame, *, tokenizer: str, end_id: int = END_OF_DOCUMENT, file_bytes: int = FILE_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens (without the separator) - one row per document."""
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    listed = materialize(write_token_files(docs, folder, tokenizer, end_id, file_bytes), "listed")
    files = listed.where("bytes is not null").select("file", "bytes")
    found = Stored(separators(files, folder, end_id, block_bytes), "separators").df
    remove(spark, folder)
    return listed.where("ordinal >= 0").join(stitch(found), ["file", "ordinal"]).select("doc_id", "n_tokens")
