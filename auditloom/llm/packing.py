"""Packing token pieces into fixed-length sequences: first-fit decreasing over a tournament tree.

Every text is cut into full sequences and at most one tail.  A full piece is a
sequence of its own and moves no further; tails are dealt to randomised groups, and
each group fills its own sequences, longest tail first, into the first sequence with
room, found by a tournament tree over the capacities left.

Defined cases: null and empty texts hold the end id alone; a text of any length is
read whole and adds one tail to one group at most; repeated rows are packed as often
as they occur; tails of one length go in the order of doc_id (nulls last), start,
checksum and row; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .runtime import materialize, slices

LENGTH = 1024
END_ID = 0
#: Tails in one group on average.
GROUP_TAILS = 8192
#: Sequence ids of full pieces begin here; those of groups are all smaller.
FULL_FROM = 1 << 62

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """Full pieces and tails of every text, with the checksum of their ids; ``salt`` tells rows of one id apart."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer)
        row = 0
        for whole in batches:
            for part in slices(whole, "text"):
                ids, counts = encode.batch(part.column(1))
                doc, start, size, crc, total, salt = [], [], [], [], [], []
                at = 0
                for d, n in zip(part.column(0).to_pylist(), counts.tolist(), strict=True):
                    own = np.append(ids[at : at + n], np.uint32(END_ID)).astype("<u4")
                    at += n
                    for s in range(0, n + 1, length):
                        piece = own[s : s + length]
                        doc.append(d)
                        start.append(s)
                        size.append(len(piece))
                        crc.append(zlib.crc32(piece))
                        total.append(n + 1)
                        salt.append(row)
                    row += 1
                columns = [pa.array(x, pa.int64()) for x in (doc, start, size, crc, total, salt)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, _PIECES)


class Tournament:
    """First bin with room: each inner node holds the largest room below it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.best = [room] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put ``size`` into the first bin that has room: (bin, room before)."""
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        room = best[node]
        bin_index = node - self.leaves
        best[node] = room - size
        while node > 1:
            node //= 2
            best[node] = max(best[2 * node], best[2 * node + 1])
        return bin_index, room


def first_fit_decreasing(sizes: list[int], length: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size (given in decreasing order)."""
    tree = Tournament(max(1, len(sizes)), length)
    placed = [tree.place(s) for s in sizes]
    return [b for b, _ in placed], [length - room for _, room in placed]


def packing(docs: DataFrame, *, tokenizer: str, length: int = LENGTH, group_tails: int = GROUP_TAILS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset - one row per piece."""
    cut = materialize(pieces(docs, tokenizer, length), "pieces")
    tails = cut.where(F.col("length") < length)
    groups = max(1, -(-tails.count() // group_tails))
    spread = tails.withColumn("g", F.pmod(F.xxhash64("doc_id", "salt", "doc_tokens", "ids_crc32"), F.lit(groups)))

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32", "salt"], ascending=[False, True, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(frame["length"].tolist(), length)
        frame["sequence_id"] = np.array(bins, dtype=np.int64) + (int(key[0]) << 32)
        frame["offset"] = np.array(offsets, dtype=np.int64)
        return frame.drop(columns=["g", "salt"])

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    full = cut.where(F.col("length") == length).drop("salt")
    full = full.withColumns({"sequence_id": F.monotonically_increasing_id() + FULL_FROM, "offset": F.lit(0).cast("long")})
    return spread.groupBy("g").applyInPandas(pack, out).unionByName(full)
