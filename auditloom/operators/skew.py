"""Joins in which one key may have a large share of the rows, such as a home page that every page links to.

Keys are counted with partial sums first.  Rows of a frequent key stay where they are
and meet a broadcast of at most ``MOST_FREQUENT`` rows; all others are dealt out by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is frequent if it has more than 1 / MOST_FREQUENT of all rows, and more than LEAST_FREQUENT; so there are fewer than MOST_FREQUENT of them.
MOST_FREQUENT, LEAST_FREQUENT = 1024, 1000


def frequent(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The frequent keys of rows."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.agg(F.count(F.lit(1)).alias("__total"))
    found = counts.where(F.col("__n") > LEAST_FREQUENT).crossJoin(F.broadcast(total))  # a total of one row
    return found.where(F.col("__n") * MOST_FREQUENT > F.col("__total")).select(*keys)


def left_join(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` left-joined to ``table`` (at most one small row for each key)."""
    often = F.broadcast(frequent(rows, keys))  # fewer than MOST_FREQUENT rows
    few = F.broadcast(table.join(often, keys, "left_semi"))  # fewer than MOST_FREQUENT rows, too
    return rows.join(often, keys, "left_semi").join(few, keys, "left").unionByName(rows.join(often, keys, "left_anti").join(table, keys, "left"))
