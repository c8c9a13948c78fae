"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket; the bucket in which a source's budget
runs out is the only one refined (three levels of 4096 buckets over a 36-bit hash
of id and text), and the rows below the threshold are taken by a filter.  Thresholds
are nested: a smaller budget takes a subset.  Nothing is sorted.  Rows at the very
threshold repeat one id and text, as a rule; of these as many are taken as end nearest
the budget, dealt to the tasks that read them by counts alone.

``mixed`` has each task of a second reading take its own list of sources, thresholds
and counts (``parts.PartLists``), so no text is shuffled; the table has to deal its
rows to the same tasks whenever it is read, as files do.

Defined cases: null text has size 0 and hashes as the empty text; a null source is a
source of its own, after all others; a null id hashes as the empty id; of rows that
repeat both id and text any may be taken; texts of any length are counted and hashed
whole; a source whose sizes are all 0 takes nothing; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .parts import PartLists
from .runtime import hot_join, hot_keys, materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
LEVEL_BITS, LEVELS = 12, 3


def hash36(id_col: str, text_col: str = "text"):
    """36 bits of the md5 of id and text."""
    both = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, 9), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Rank of every source by code point, nulls last, from 0: range partitions, each numbered by itself after those before it."""
    spark = sources.sparkSession
    n = spark.sparkContext.defaultParallelism
    order = [F.col("source").asc_nulls_last()]
    dealt = materialize(sources.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranges")
    before, total = {}, 0
    for row in dealt.groupBy("part").count().orderBy("part").collect():  # one row for each of n partitions
        before[row["part"]], total = total, total + row["count"]
    start = F.coalesce(*[F.when(F.col("part") == p, F.lit(x)) for p, x in before.items()], F.lit(0)) if before else F.lit(0)
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("rank", (within + start).cast("long")).drop("part")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size -> also target: shares by weight, held at ``most`` times the size, the excess shared again."""
    cycle = F.array(*[F.lit(w) for w in weights])
    own = materialize(ranked(sources).withColumn("weight", F.element_at(cycle, (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")).cast("long")), "weights")
    wide = "decimal(38,0)"
    row = own.agg(F.sum("source_size"), F.sum("weight")).first()
    total, rest, weight = row[0] or 0, row[0] or 0, row[1] or 0
    while True:
        held = (F.col("source_size") * most).cast(wide) * F.lit(weight).cast("decimal(18,0)") < F.lit(rest).cast("decimal(18,0)") * F.col("weight")
        row = own.agg(F.sum(F.when(held, F.col("source_size") * most)), F.sum(F.when(~held, F.col("weight")))).first()
        now = (total - (row[0] or 0), row[1] or 0)
        if now == (rest, weight) or not now[1]:
            break
        rest, weight = now
    share = F.lit(rest).cast("long") * F.col("weight") / F.lit(max(weight, 1)).cast("long")
    return own.withColumn("target", F.when(held, (F.col("source_size") * most).cast("double")).otherwise(share.cast("double"))).select("source", "source_size", "target")


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """source, repeats, cut, left: every row is taken ``repeats`` times, and once more if its hash is below ``cut``; of the rows at ``cut`` some more, of ``left`` in all."""
    size = F.col("source_size")
    repeats = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    goals = goals.withColumn("repeats", repeats).withColumn("budget", F.floor(F.col("target") - F.col("repeats") * size).cast("long"))
    state = materialize(goals.select("source", "source_size", "target", "repeats", "budget", F.lit(0).cast("long").alias("cut"), F.lit(0).cast("long").alias("below")), "goals")
    rows = sized
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        prefix = F.shiftrightunsigned(F.col("hash"), shift)
        if level:
            last = state.select(F.col("source").alias("s"), F.shiftrightunsigned(F.col("cut"), shift + LEVEL_BITS).alias("p"))
            rows = sized.join(last, F.col("source").eqNullSafe(F.col("s")) & (F.shiftrightunsigned(F.col("hash"), shift + LEVEL_BITS) == F.col("p"))).select("source", "hash", "size")
        sums = rows.groupBy("source", prefix.alias("bucket")).agg(F.sum("size").alias("size"))
        own = state.select(F.col("source").alias("s"), "budget", F.col("below").alias("base"))
        in_source = Window.partitionBy("source").orderBy("bucket")
        upto = sums.join(own, F.col("source").eqNullSafe(F.col("s"))).withColumn("upto", F.col("base") + F.sum("size").over(in_source))
        over = upto.where(F.col("upto") > F.col("budget")).groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("size")).alias("below"), "upto")).alias("edge"))
        edge = over.select(F.col("source").alias("s"), "edge")
        found = state.join(edge, F.col("source").eqNullSafe(F.col("s")), "left")
        cut, below = F.shiftleft(F.col("edge.bucket"), shift), F.col("edge.below")
        state = materialize(found.select("source", "source_size", "target", "repeats", "budget", F.coalesce(cut, F.lit(1 << LEVEL_BITS * LEVELS)).cast("long").alias("cut"), F.coalesce(below, F.col("below")).alias("below")), "edges")
    return state.select("source", "source_size", "target", "repeats", "cut", (F.col("budget") - F.col("below")).alias("left"))


def sized_rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words), hash, part (the task that reads the row)."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), hash36("doc_id").alias("hash"), F.spark_partition_id().alias("part"))


#: A source as a key that is never null (fixed marks).
def _key(source: str = "source"):
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def cuts_of(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """key, source_size, target, repeats, cut of every source; key, part, quota: how many rows at the threshold each task takes."""
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    cuts = materialize(thresholds(sized, goals).withColumn("key", _key()), "cuts")
    at = cuts.select("key", "cut", "left").where("left > 0")
    rows = hot_join(sized.select(_key().alias("key"), "part", "size", "hash"), at, "key", hot_sources(sized)).where("hash = cut and size > 0")
    counts = materialize(rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.first("left").alias("left")), "edges")
    # one row for each task that has rows at a source's threshold
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.floor((F.col("left") + F.floor((F.col("size") - 1) / 2)) / F.col("size"))  # the nearest multiple, the smaller of two
    quota = F.least(F.col("n"), F.greatest(F.lit(0), wanted - F.coalesce(F.sum("n").over(before), F.lit(0))))
    return cuts.drop("source", "left"), counts.select("key", "part", quota.cast("long").alias("quota")).where("quota > 0")


def hot_sources(sized: DataFrame) -> DataFrame:
    """Sources with a large share of all rows."""
    return hot_keys(sized.groupBy(_key().alias("key")).agg(F.count(F.lit(1)).alias("n")), "key", "n")


def source_mixing(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken - one row per input row; reruns agree."""
    sized = materialize(sized_rows(docs).withColumn("key", _key()), "sizes")
    cuts, quotas = cuts_of(sized)
    joined = hot_join(sized, cuts, "key", hot_sources(sized))
    taken = F.col("repeats") + F.when(F.col("hash") < F.col("cut"), 1).otherwise(0)
    rest = joined.where((F.col("hash") != F.col("cut")) | (F.col("size") == 0)).withColumn("copies", taken)
    edge = joined.where((F.col("hash") == F.col("cut")) & (F.col("size") != 0)).join(quotas, ["key", "part"], "left")
    among = Window.partitionBy("key", "part").orderBy("doc_id")  # rows of one task at most
    edge = edge.withColumn("copies", taken + F.when(F.row_number().over(among) <= F.coalesce("quota", F.lit(0)), 1).otherwise(0)).drop("quota")
    return rest.unionByName(edge).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its source's repeats and threshold say."""
    sized = materialize(sized_rows(docs).withColumn("key", _key()), "sizes")
    cuts, quotas = cuts_of(sized)
    met = sized.select("key", "part").distinct()
    own = hot_join(met, cuts.select("key", "repeats", "cut"), "key", hot_keys(met.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key", "n"))
    lists = PartLists(own.join(quotas, ["key", "part"], "left").select("part", "key", "repeats", "cut", F.coalesce("quota", F.lit(0).cast("long")).alias("quota")), "mix")

    def copies(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        table = lists.of(TaskContext.get().partitionId()).to_pydict()
        repeats, cut, quota = (dict(zip(table["key"], table[c], strict=True)) for c in ("repeats", "cut", "quota"))
        for keys, hashes, some in batches:
            out = keys.map(repeats).to_numpy() + (hashes.to_numpy() < keys.map(cut).to_numpy())
            for i in np.flatnonzero((hashes.to_numpy() == keys.map(cut).to_numpy()) & some.to_numpy()):
                if quota[keys.iloc[i]] > 0:
                    quota[keys.iloc[i]] -= 1
                    out[i] += 1
            yield pd.Series(out.astype(np.int32))

    times = F.pandas_udf(copies, "int").asNondeterministic()
    some = F.rlike(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD))
    out = docs.withColumn("__copies", times(_key(), hash36("doc_id"), some)).withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE_SQL = r"""
with recursive sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 9))::bigint as hash
  from documents
), own as (
  select source, sum(size)::bigint as source_size,
         case ((row_number() over (order by source asc nulls last)) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end::bigint as weight
  from sized group by source
), pass(i, rest, weights) as (
  select 0, sum(source_size)::bigint, sum(weight)::bigint from own
  union all
  select i + 1,
         ((select sum(source_size) from own) - coalesce((select sum(3 * source_size) from own where 3 * source_size * pass.weights < pass.rest * weight), 0))::bigint,
         (select sum(weight) from own where not (3 * source_size * pass.weights < pass.rest * weight))::bigint
  from pass where i < 40
), final as (
  select rest, weights from pass order by i desc limit 1
), goals as (
  select source, source_size,
         case when 3 * source_size * weights < rest * weight then (3 * source_size)::double else rest * weight / weights end as target
  from own, final
), cut as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as repeats from goals
), upto as (
  select s.doc_id, s.size, c.source_size, c.target, c.repeats, floor(c.target - c.repeats * c.source_size)::bigint as budget,
         sum(s.size) over (partition by s.source order by s.hash) as total,
         sum(s.size) over (partition by s.source, s.hash) as here,
         row_number() over (partition by s.source, s.hash) as n
  from sized s join cut c on s.source is not distinct from c.source
)
select doc_id, size, source_size, target,
       (size * (repeats + case when total <= budget then 1
                               when total - here <= budget and (total - here) + n * size - budget < budget - ((total - here) + (n - 1) * size) then 1
                               else 0 end))::bigint as taken
from upto
"""
