"""Shared folder, materialised steps and numpy word hashing for the operators.

Everything that one step leaves for another goes through the folder named by
``spark.checkpoint.dir`` (shared by driver and executors); a step written there
survives the loss of any executor and cuts the lineage.
"""

from __future__ import annotations

import atexit
import hashlib
import re
import secrets
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder: ``spark.checkpoint.dir``; where that is unset a fresh temporary folder on a local master (tests), and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="auditloom-")
    return _own_dirs[app]


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; removed when the driver's Python ends."""
    raw = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/auditloom-{label}-{uuid.uuid4().hex}")
    path = raw.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(raw).toString()  # with scheme, as executors may have no default
    path = re.sub("^file:/+", "file:///", path)
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session is gone: nothing can be removed through it any more
        pass


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Stored:
    """A written step: ``df`` reads it, ``drop()`` deletes its files once nothing reads it any more."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = scratch(self.spark, label)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    return Stored(df, label).df


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Number of partitions for so many rows, at least the default parallelism."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // per_partition))


# ---------------------------------------------------------------------------
# Hot keys.

#: A key is hot if it has more than LEAST_HOT rows, and more than 1 / HOT of the rows of all such keys; so there are at most HOT of them.
HOT, LEAST_HOT = 4096, 64


def hot_keys(counts: DataFrame, key: str, n: str) -> DataFrame:
    """The hot ones among ``counts`` (one row per key with its ``n`` rows): key, copies (into how many parts its rows should be cut) - at most HOT rows, with at most 2 HOT copies in all."""
    large = counts.where(F.col(n) > LEAST_HOT).select(key, F.col(n).alias("n"))
    total = large.agg(F.sum("n")).first()[0]
    if total is None:
        return counts.sparkSession.createDataFrame([], T.StructType([counts.schema[key], T.StructField("copies", T.IntegerType())]))
    most = max(LEAST_HOT, total // HOT)
    return materialize(large.where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("copies")), "hot")


def hot_join(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table`` (at most one small row per key) so that no task gets all rows of a hot key: these stay where they are and meet a broadcast of at most HOT rows of ``table``; all others are dealt out by key."""
    keys = F.broadcast(hot.select(key))  # at most HOT rows
    few = F.broadcast(table.join(keys, key, "left_semi"))  # at most HOT rows, too
    return rows.join(keys, key, "left_semi").join(few, key, how).unionByName(rows.join(keys, key, "left_anti").join(table.hint("merge"), key, how))


def salted_join(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame, by: str) -> DataFrame:
    """``rows`` joined to ``table`` (at most one row per key, of any width): the rows of a hot key are cut into parts by the hash of ``by``, each with a copy of the table's row."""
    copies = F.broadcast(hot.select(F.col(key).alias("__hot"), "copies"))  # at most HOT rows
    left = rows.join(copies, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.pmod(F.xxhash64(by), F.coalesce("copies", F.lit(1)).cast("long")).cast("int")).drop("__hot", "copies")
    right = table.join(copies, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("__hot", "copies")
    return left.join(right.hint("merge"), [key, "__salt"]).drop("__salt")


# ---------------------------------------------------------------------------
# Words of UTF-8 buffers.  Both word classes are classes of bytes: every byte of
# a character beyond ASCII is 0x80 or more and belongs to words.

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SEEDS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_STEP = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Longer words (in bytes) are hashed one by one.
_LONG_WORD = 512

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def new_key() -> int:
    """A random key of 64 bits, not 0."""
    return secrets.randbits(64) or 1


class Words:
    """Words of a batch of texts: ``doc[i]:doc[i+1]`` are the words of text i; ``starts``/``ends`` are byte positions in ``buf``."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, classes: np.ndarray):
        self.buf, self.offsets = buf, offsets
        n = len(buf)
        inside = classes[buf]
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        firsts = offsets[:-1]
        before[firsts[firsts < n]] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        lasts = offsets[1:]
        after[lasts[lasts > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.doc)

    def hashes(self, which: int = 0, key: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, eight bytes at a time through a mixing step; ``which`` picks one of two independent families.

        Words that collide can be made for a key that is known, so what must not be
        mistaken takes a key drawn at random (``new_key``), by one worker or for one job.
        """
        length = self.ends - self.starts
        seed = mix(np.array([_SEEDS[which] ^ key], dtype=np.uint64)) if key else np.array([_SEEDS[which]], dtype=np.uint64)
        out = length.astype(np.uint64) * np.uint64(_STEP[which]) ^ seed
        padded = np.concatenate([self.buf, np.zeros(8, dtype=np.uint8)])
        eight = np.ndarray((len(self.buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from every place on
        at = np.flatnonzero(length <= _LONG_WORD)
        done = 0
        while len(at):
            chunk, left = eight[self.starts[at] + done], length[at] - done
            short = left < 8
            chunk[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
            out[at] = mix(out[at] ^ chunk)
            done += 8
            at = at[left > 8]
        for i in np.flatnonzero(length > _LONG_WORD):
            own = hashlib.blake2b(self.buf[self.starts[i] : self.ends[i]].tobytes(), digest_size=8, salt=str(which).encode(), key=key.to_bytes(8, "little") if key else b"")
            out[i] = np.frombuffer(own.digest(), dtype="<u8")[0]
        return out

    def grams(self, hashed: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words within a text, and how many each text has."""
        counts = np.maximum(self.counts - (k - 1), 0)
        n = len(hashed) - k + 1
        if n <= 0:
            return np.empty(0, dtype=np.uint64), counts
        out = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            out = out * np.uint64(_STEP[which]) + hashed[j : j + n]
        text = np.repeat(np.arange(len(self.counts)), self.counts)
        return mix(out[text[:n] == text[k - 1 :]] ^ np.uint64(k)), counts


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20):
    """Cut a batch so that each part has about ``most_bytes`` of text (a longer single text is a part of its own)."""
    _, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = min(j, n)


def list_column(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An Arrow list<int64> column from flat values and lengths."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
