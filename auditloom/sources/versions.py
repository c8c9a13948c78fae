"""Tables of audits in versions: written apart, and switched by a numbered log.

A version of an audit's table is a folder of its own that never changes.  What holds
is what the audit's log says last: one small file for each switch, which names the
folder of every table.  So all tables of a step change at once, an empty result
leaves an empty table, and a writer that dies before its switch leaves everything as
it was.  Log files are numbered, and a number can be taken once: of two writers that
start from the same state one gets a ``Conflict``, and order never depends on a clock.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from urllib.parse import quote, unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Buckets of a table that is merged into rather than replaced.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has taken the log's next number."""


class Files:
    """The few file operations that logs and sinks need, through Hadoop's interface."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path(folder).getFileSystem(self._conf)

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        source = self.fs.open(self.path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()

    def create(self, name: str, content: str) -> bool:
        """Write a whole file under a name that is not taken; False if it is."""
        draft, final = self.path(f"{name}.{uuid.uuid4().hex}.draft"), self.path(name)
        out = self.fs.create(draft, False)
        out.write(bytearray(content.encode()))
        out.close()
        rename = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        no_options = self._jvm.java.lang.reflect.Array.newInstance(rename, 0)  # an existing name is an error
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self._conf)
        try:
            context.rename(self.fs.makeQualified(draft), self.fs.makeQualified(final), no_options)
            return True
        except Py4JJavaError as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception.toString()):
                return False
            raise

    def remove(self, folder: str) -> None:
        self.fs.delete(self.path(folder), True)


class Log:
    """Numbered entries (JSON) in a folder; each number is given once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder, self._files = folder, Files(spark, folder)

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self._files.names(self.folder) if n.endswith(".json")]

    def last(self) -> tuple[int, dict]:
        """The last number and its entry; (0, {}) of an empty log."""
        n = max(self.numbers(), default=0)
        return n, self.entry(n) if n else {}

    def entry(self, n: int) -> dict:
        return json.loads(self._files.read(f"{self.folder}/{n:010d}.json"))

    def entries(self) -> list[dict]:
        return [self.entry(n) for n in self.numbers()]

    def append(self, entry: dict, after: int) -> int:
        """Add the entry that follows number ``after``; Conflict if another one follows it already."""
        if not self._files.create(f"{self.folder}/{after + 1:010d}.json", json.dumps(entry, sort_keys=True)):
            raise Conflict(f"entry {after + 1} of {self.folder} was written by another run")
        return after + 1


def _of_table(entry: dict, name: str) -> dict[str, str]:
    """A table's folders by bucket (named "" where it has none)."""
    return {k.partition("#")[2]: v for k, v in entry.items() if k.partition("#")[0] == name}


class Versions:
    """Versioned tables of many audits in one folder; tables carry ``audit_id``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._files = spark, folder.rstrip("/"), Files(spark, folder)

    def _log(self, audit_id: str) -> Log:
        return Log(self.spark, f"{self.folder}/_log/{quote(audit_id, safe='')}")

    def audits(self) -> list[str]:
        return [unquote(n) for n in self._files.names(f"{self.folder}/_log")]

    def write(self, audit_id: str, rows: dict[str, DataFrame]) -> int:
        """Replace an audit's rows in all tables given, at once; other tables and audits stay.  Rows of other audits are left out."""
        log = self._log(audit_id)
        before, held = log.last()
        made = {name: self.stage(audit_id, name, df) for name, df in rows.items()}
        return log.append(held | made, before)

    def stage(self, audit_id: str, name: str, rows: DataFrame) -> str:
        """Write a version of one table; nobody reads it before the log names it.  Returns its folder's name."""
        version = f"{name}/{quote(audit_id, safe='')}/{uuid.uuid4().hex}"
        rows.where(F.col("audit_id") == audit_id).write.parquet(f"{self.folder}/{version}")
        return version

    def read(self, name: str, schema: T.StructType, *audit_ids: str) -> DataFrame:
        """A table's rows of the audits given (all audits without any); only their folders are read."""
        found = [_of_table(self._log(a).last()[1], name) for a in audit_ids or self.audits()]
        paths = [f"{self.folder}/{v}" for own in found for v in own.values()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def upsert(self, audit_id: str, name: str, fresh: DataFrame, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], schema: T.StructType, others: dict[str, DataFrame] | None = None, buckets: int = BUCKETS) -> int:
        """Merge rows into a table that is dealt to buckets by its keys: only buckets that fresh rows fall into are read and written, all others keep their files.  ``merge`` gets old and fresh rows of these buckets; ``others`` are replaced in the same switch."""
        log = self._log(audit_id)
        before, held = log.last()
        old = _of_table(held, name)
        if any(int(k.partition("/")[2]) != buckets for k in old):
            raise ValueError(f"{name} of {audit_id} is dealt to another number of buckets")
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        fresh = fresh.where(F.col("audit_id") == audit_id)
        touched = sorted(r["b"] for r in fresh.select(bucket.alias("b")).distinct().collect())  # at most ``buckets`` rows
        paths = [f"{self.folder}/{old[k]}" for b in touched if (k := f"{b}/{buckets}") in old]
        base = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        version = f"{name}/{quote(audit_id, safe='')}/{uuid.uuid4().hex}"
        if touched:
            merge(base, fresh).withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{version}")
        made = {f"{name}#{b}/{buckets}": f"{version}/bucket={b}" for b in touched}
        made |= {n: self.stage(audit_id, n, df) for n, df in (others or {}).items()}
        return log.append(held | made, before)

    def clean(self, audit_id: str, keep: int = 1) -> int:
        """Delete versions that none of the last ``keep`` log entries names; returns how many.  Writers of this audit must be at rest."""
        log = self._log(audit_id)
        held = {"/".join(v.split("/")[:3]) for n in log.numbers()[-keep:] for v in log.entry(n).values()}
        gone = 0
        for name in self._files.names(self.folder):
            base = f"{name}/{quote(audit_id, safe='')}"
            for version in self._files.names(f"{self.folder}/{base}") if name != "_log" else []:
                if f"{base}/{version}" not in held:
                    self._files.remove(f"{self.folder}/{base}/{version}")
                    gone += 1
        return gone
