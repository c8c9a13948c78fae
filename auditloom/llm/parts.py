"""Lists for scan tasks: what each task of a scan has to know about its own rows.

A scan deals its rows to the same tasks each time it is planned over the same files.
So a first reading of the narrow columns tells which rows meet which task, any join
on these rows yields a list for each task, and a second reading of the wide columns
has each task take its own list.  Wide columns are never shuffled, and no task reads
more than the list of its own split, whatever the table's size.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import scratch
from .warc import file_system

#: Splits whose lists share a folder.
SPLITS = 32


class PartLists:
    """Rows with a column ``part`` (the number of a scan's task), written so that ``of`` reads those of one task."""

    def __init__(self, rows: DataFrame, label: str):
        self.path = scratch(rows.sparkSession, label)
        dealt = rows.withColumn("splits", F.floor(F.col("part") / SPLITS).cast("int"))
        dealt.repartition("part").sortWithinPartitions("part").write.partitionBy("splits").parquet(self.path)
        self.schema = pa.schema([(c, {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}[t]) for c, t in rows.dtypes])

    def of(self, part: int) -> pa.Table:
        """The list of one task, in a worker."""
        from pyarrow import fs, parquet

        store, base = file_system(self.path)
        own = f"{base}/splits={part // SPLITS}"
        if store.get_file_info(own).type == fs.FileType.NotFound:
            return self.schema.empty_table()
        return parquet.read_table(own, filesystem=store, columns=self.schema.names, filters=[("part", "=", part)], partitioning=None).cast(self.schema)
