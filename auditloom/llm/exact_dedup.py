"""Exact deduplication against immutable snapshots.

A snapshot's digests are dealt to buckets; each bucket has a static binary fuse
filter, built once and never changed.  Digests of an incoming batch are grouped
within the batch, screened by the filters of every earlier snapshot, and only those
that pass join the exact buckets.  Each task of the second reading then takes the
list of repeated digests among its own rows (``parts.PartLists``), so texts that occur
once never enter a shuffle, at any size.  Members of every class of more than one row
are compared byte for byte with the row that stays.

The table has to deal its rows to the same tasks whenever it is read, as files do.

Defined cases: null text is empty text; empty texts are equal to each other; texts of
any length are digested and compared whole; a null id never stays unless all ids of
its class are null; rows that repeat both id and text each count in ``group_size``
and are all marked kept (a tie); an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fuse
from .parts import PartLists
from .runtime import Stored, hot_join, hot_keys, materialize, partitions_for, salted_join

#: Digests in one bucket, so in one filter and one task's group.
BUCKET_ROWS = 200_000


def _bucket(n: int):
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int")


def _key64(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), dtype="<u8") if len(digests) else np.empty(0, dtype=np.uint64)


def classes(rows: DataFrame) -> DataFrame:
    """Digest classes of one batch: digest, last_id (largest id), n_rows."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("n_rows"))


def _dealt(classes_: DataFrame, buckets: int) -> DataFrame:
    return classes_.select(_bucket(buckets).alias("bucket"), "digest")


def filters_of(classes_: DataFrame, buckets: int) -> DataFrame:
    """One binary fuse filter per bucket of digests."""

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": [key[0]], "filter": [fuse.build(_key64(frame["digest"]))]})

    return _dealt(classes_, buckets).groupBy("bucket").applyInPandas(one, "bucket int, filter binary")


@dataclass(frozen=True)
class Snapshot:
    """An immutable batch: its classes (digest, last_id, n_rows), and a filter for each of its buckets."""

    classes: DataFrame
    filters: DataFrame
    buckets: int

    @classmethod
    def of(cls, rows: DataFrame) -> Snapshot:
        """The snapshot of a batch of rows (digest, doc_id)."""
        found = materialize(classes(rows), "classes")
        buckets = partitions_for(rows.sparkSession, found.count(), BUCKET_ROWS)
        return cls(found, materialize(filters_of(found, buckets), "filters"), buckets)

    def save(self, folder: str) -> None:
        """Write the snapshot to a folder, where ``load`` finds it."""
        self.classes.withColumn("bucket", _bucket(self.buckets)).write.parquet(f"{folder}/classes")
        self.filters.withColumn("buckets", F.lit(self.buckets)).write.parquet(f"{folder}/filters")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Snapshot:
        """A saved snapshot; its filters are those that were built with it."""
        filters = spark.read.schema("bucket int, filter binary, buckets int").parquet(f"{folder}/filters")
        first = filters.select("buckets").first()
        return cls(spark.read.schema("digest binary, last_id long, n_rows long").parquet(f"{folder}/classes"), filters.drop("buckets"), first[0] if first else 1)

    def screen(self, incoming: DataFrame) -> DataFrame:
        """digest of the incoming classes that pass their bucket's filter."""

        def probe(frame: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            if not len(frame) or not len(own):
                return pd.DataFrame({"digest": pd.Series([], dtype=object)})
            return frame.loc[fuse.contains(own["filter"].iloc[0], _key64(frame["digest"])), ["digest"]]

        return _dealt(incoming, self.buckets).groupBy("bucket").cogroup(self.filters.groupBy("bucket")).applyInPandas(probe, "digest binary")

    def known(self, incoming: DataFrame) -> DataFrame:
        """The snapshot's classes that incoming classes (digest) belong to: only what passes a filter meets the exact buckets."""
        return self.classes.join(self.screen(incoming), "digest", "left_semi")


def listed(rows: DataFrame, lists: PartLists) -> DataFrame:
    """The rows (column digest) whose digest is in the list of the task that reads them."""

    def among(digests: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = lists.of(TaskContext.get().partitionId()).column("digest").unique()
        for batch in digests:
            yield pd.Series(pc.is_in(pa.array(batch, pa.binary()), value_set=own).to_numpy(zero_copy_only=False))

    # else the optimiser would also apply it to what the rows are joined with, in other tasks
    own_list = F.pandas_udf(among, "boolean").asNondeterministic()
    return rows.where(own_list("digest"))


def repeated(digests: DataFrame, snapshots: int) -> DataFrame:
    """digest, last_id, n_rows of the classes of more than one row; rows (doc_id, digest, batch) come in as so many snapshots."""
    held: list[Snapshot] = []
    common = None
    for i in range(snapshots):
        new = Snapshot.of(digests.where(F.col("batch") == i))
        for old in held:
            both = old.known(new.classes).select("digest")
            common = both if common is None else common.unionByName(both)
        held.append(new)
    all_classes = functools.reduce(DataFrame.unionByName, [s.classes for s in held])
    within = all_classes.where("n_rows > 1").select("digest", "last_id", "n_rows")
    if common is None:
        return within
    common = materialize(common.distinct(), "common")
    across = all_classes.join(common, "digest", "left_semi").groupBy("digest").agg(F.max("last_id").alias("last_id"), F.sum("n_rows").alias("n_rows"))
    return across.unionByName(within.join(common, "digest", "left_anti"))


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, digest, part (the task that reads the row)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.spark_partition_id().alias("part"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def grouped(docs: DataFrame, id_col: str, text_col: str, snapshots: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, part, digest, keep_id, group_size of the rows whose text repeats; doc_id, part, digest of the others."""
    read = _read(docs, id_col, text_col)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(snapshots)).cast("int")
    digests = materialize(read.select("doc_id", "digest", "part", batch.alias("batch")), "digests")
    several = materialize(repeated(digests, snapshots), "several")
    hot = hot_keys(several, "digest", "n_rows")
    own = hot_join(digests.select("digest", "part"), several.select("digest"), "digest", hot, "left_semi")
    lists = PartLists(own.distinct(), "repeated")

    kept = several.select("digest", "last_id")
    members = Stored(salted_join(listed(read, lists), kept, "digest", hot, "doc_id").select("doc_id", "part", "digest", "last_id", "text"), "members")
    if members.df.count() != (several.agg(F.sum("n_rows")).first()[0] or 0):
        raise RuntimeError("the documents were dealt to other partitions when they were read again")
    stays = members.df.where(F.col("doc_id").eqNullSafe(F.col("last_id"))).groupBy("digest").agg(F.min("text").alias("stay_text"))
    stays = Stored(stays, "stays")
    same = F.col("text") == F.col("stay_text")
    checked = salted_join(members.df, stays.df, "digest", hot, "doc_id").select("doc_id", "part", "digest", F.when(~same, F.col("text")).alias("variant"))
    checked = materialize(checked, "checked")
    members.drop()
    stays.drop()
    counted = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    equal = checked.where("variant is null").select("doc_id", "part", "digest")
    equal = hot_join(equal, materialize(equal.groupBy("digest").agg(*counted), "groups"), "digest", hot)
    other = checked.where("variant is not null")  # texts of one digest that differ
    other = other.join(other.groupBy("digest", "variant").agg(*counted), ["digest", "variant"])
    found = equal.unionByName(other.drop("variant")).select("doc_id", "part", "digest", "keep_id", "group_size")
    single = digests.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(kept, "digest", "left_anti")
    return found, single.select("doc_id", "part", "digest")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", snapshots: int = 2) -> DataFrame:
    """Keep the largest id of each set of equal texts.

    The table comes in as ``snapshots`` immutable batches: each is grouped by itself
    and screened against the filters of those before it.
    Returns doc_id, keep_id, group_size, kept, text_sha256 - one row per input row.
    """
    found, single = grouped(docs, id_col, text_col, snapshots)
    single = single.withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")})
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return found.unionByName(single).select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, *, snapshots: int = 2) -> DataFrame:
    """``docs`` without the rows that exact_dedup drops; of rows that tie on id and text one stays.  Texts stay where they are read: each task takes the list of its rows of repeated texts, and of each how many to keep."""
    found, _ = grouped(docs, "doc_id", "text", snapshots)
    by_row = found.groupBy("part", "doc_id", "digest").agg(F.max(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("stays"))
    first = found.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("doc_id", "digest").agg(F.min("part").alias("first"))
    first = first.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), "first")
    marked = by_row.join(first, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    lists = PartLists(marked.select("part", "doc_id", "digest", F.coalesce((F.col("stays") & (F.col("part") == F.col("first"))).cast("int"), F.lit(0)).alias("keep")), "keep")

    def stays(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = lists.of(TaskContext.get().partitionId())
        left = {(None if i is None else i, d): k for i, d, k in zip(own.column("doc_id").to_pylist(), own.column("digest").to_pylist(), own.column("keep").to_pylist(), strict=True)}
        for ids, known, digests in batches:
            out = np.ones(len(ids), dtype=bool)
            for n, (i, there, d) in enumerate(zip(ids.tolist(), known.tolist(), digests, strict=True)):
                key = (int(i) if there else None, bytes(d))
                if key in left:
                    out[n] = left[key] > 0
                    left[key] -= 1
            yield pd.Series(out)

    wanted = F.pandas_udf(stays, "boolean").asNondeterministic()
    doc_id = F.col("doc_id").cast("long")
    return docs.where(wanted(F.coalesce(doc_id, F.lit(0)), doc_id.isNotNull(), F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))))


ORACLE_SQL = """
select doc_id,
       max(doc_id) over (partition by coalesce(text, '')) as keep_id,
       count(*) over (partition by coalesce(text, '')) as group_size,
       doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
"""
