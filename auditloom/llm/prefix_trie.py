"""Prefix trie of conversations, rolled up by pointer jumping.

A node is named by the digest of the turns that lead to it, and every node knows its
parent's digest.  Numbers of leaves and savings reach all ancestors in rounds of
doubling: a round adds to each node what the nodes whose pointer stands on it have
gathered, then moves every pointer to where the one it stands on points, so a
conversation of n turns takes about log2(n) rounds.

No task needs all turns of a conversation, all children of a node or all
conversations that end at one:

* turns are numbered by range partitions of (conversation, turn), each counted by
  itself, with one carried count for the conversation that a partition begins in;
* a prefix digest is made of digests of blocks of ``BLOCK`` turns; digests of whole
  runs of blocks come from doubling rounds of their own;
* what hangs on one parent is summed before it is shuffled, and what each child needs
  of a common parent is met by a broadcast of at most ``runtime.HOT`` rows;
* the ids that end at a node are joined to texts in range partitions, at most
  ``PIECE_IDS`` in each.  SHA-256 can only be taken in order, so the one digest of a
  node's ids reads these texts one after the other, one at a time in memory.

Defined cases: a null role or text is empty; turns of one conversation and number go
by the digest of role and text (null turn first), repeated rows stand next to each
other; rows without conv_id belong to no conversation and are left out; a
conversation of any length and turns of any length are taken whole; further columns
are not read; without conversations there is no root and the result is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Stored, hot_join, hot_keys, materialize

#: Conversations of one family share its first turns: those of conv_id - conv_id % FAMILY; of these at most MOST_SHARED.
FAMILY, MOST_SHARED = 5, 8
#: Turns whose digests are joined within one window.
BLOCK = 32
#: Conversation ids in one text of the ids that end at a node.
PIECE_IDS = 1024
_ROOT = b""


def turn_digest(role: str = "role", text: str = "text"):
    """SHA-256 of a role and a text, told apart by the role's length."""
    r, t = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.unhex(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256))


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest, bytes of every turn, in the order of turn and digest."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_digest().alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows = rows.where("conv_id is not null").withColumn("row", F.monotonically_increasing_id())  # deals out repeated rows, too
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            first = np.ones(len(ids), dtype=bool)
            first[1:] = ids[1:] != ids[:-1]
            starts = np.flatnonzero(first)
            local = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids)))) + 1
            if ids[0] == last:
                local[: starts[1] if len(starts) > 1 else len(ids)] += n
            last, n = ids[-1], int(local[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, dtype=np.int32)), batch.column(0), pa.array(local), batch.column(2), batch.column(3)], ["part", "conv_id", "local", "digest", "bytes"])

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    dealt = materialize(dealt.mapInArrow(count, "part int, conv_id long, local long, digest binary, bytes long"), "turns")
    ends = dealt.groupBy("part", "conv_id").agg(F.max("local").alias("n"))
    ends = ends.groupBy("part").agg(F.min(F.struct("conv_id", "n")).alias("first"), F.max(F.struct("conv_id", "n")).alias("last"))
    carried, conv, n = [], None, 0
    for row in ends.orderBy("part").collect():  # one row for each range partition
        if row["first"]["conv_id"] == conv:
            carried.append((row["part"], conv, n))
        before = n if row["last"]["conv_id"] == conv else 0
        conv, n = row["last"]["conv_id"], before + row["last"]["n"]
    carried = turns.sparkSession.createDataFrame(carried, "part int, conv_id long, before long")
    # broadcast: at most one row for each range partition
    return dealt.join(F.broadcast(carried), ["part", "conv_id"], "left").select("conv_id", (F.col("local") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv_id, pos, digest, bytes, ends: whether it is the last) and the conversations (conv_id, n: their rebuilt turns).

    A conversation c takes the first h turns of c - c % FAMILY, then its own after the first h.
    """
    own = materialize(numbered(turns), "numbered")
    share = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("long")
    convs = materialize(own.groupBy("conv_id").agg(F.max("pos").alias("own_n")).withColumns({"h": share, "base": F.col("conv_id") - F.col("conv_id") % FAMILY}), "convs")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("own_n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0).cast("long"))))
    convs = materialize(convs.select("conv_id", "own_n", "h", "base", "taken", (F.col("taken") + F.greatest(F.lit(0).cast("long"), F.col("own_n") - F.col("h"))).alias("n")), "convs")
    hot = hot_keys(convs, "conv_id", "own_n")
    later = hot_join(own, convs.select("conv_id", "h", "taken", "n"), "conv_id", hot).where("pos > h")
    later = later.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "bytes", "n")
    # at most MOST_SHARED rows meet at most 2 * FAMILY - 1 conversations
    shared = own.where(F.col("pos") <= MOST_SHARED).withColumnRenamed("conv_id", "base").join(convs.where("taken > 0").select("conv_id", "base", "taken", "n"), "base")
    shared = shared.where("pos <= taken").select("conv_id", "pos", "digest", "bytes", "n")
    rows = later.unionByName(shared).select("conv_id", "pos", "digest", "bytes", (F.col("pos") == F.col("n")).alias("ends"))
    return rows, convs.select("conv_id", "n")


def _joined(*digests: str) -> Column:
    return F.unhex(F.sha2(F.concat(*digests), 256))


def named(rows: DataFrame) -> DataFrame:
    """Rebuilt turns with ``node`` and ``parent``: digests of the turns up to this one and up to the one before (the root's is empty)."""
    block = F.floor((F.col("pos") - 1) / BLOCK).cast("long")
    upto = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    by_pos = Window.partitionBy("conv_id", "block").orderBy("pos")
    rows = rows.withColumn("block", block).withColumn("inside", F.unhex(F.sha2(F.array_join(F.transform(F.collect_list("digest").over(upto), F.hex), "").cast("binary"), 256)))
    rows = materialize(rows.withColumn("lag", F.lag("inside").over(by_pos)).drop("digest"), "blocks")
    first = rows.where("block = 0").select("conv_id", "pos", "bytes", "ends", F.col("inside").alias("node"), F.coalesce("lag", F.lit(_ROOT)).alias("parent"))
    runs = _runs(rows)
    if runs is None:
        return first
    later = rows.where("block > 0").join(runs, ["conv_id", "block"])  # at most BLOCK rows for each key
    complete = F.col("pos") % BLOCK == 0
    node = F.when(complete, F.col("upto")).otherwise(_joined("before", "inside"))
    parent = F.when(F.col("lag").isNull(), F.col("before")).otherwise(_joined("before", "lag"))
    return first.unionByName(later.select("conv_id", "pos", "bytes", "ends", node.alias("node"), parent.alias("parent")))


def _runs(rows: DataFrame) -> DataFrame | None:
    """conv_id, block (from 1), before, upto: digests of all turns before a block, and up to its end where it is complete; None if no conversation goes beyond one block."""
    most = rows.where("block > 0").agg(F.max("block")).first()[0]
    if most is None:
        return None
    long = rows.where("block > 0").select("conv_id").distinct()
    full = rows.where(F.col("pos") % BLOCK == 0).select("conv_id", "block", F.col("inside").alias("run"))
    state = Stored(full.join(long, "conv_id", "left_semi"), "runs")  # run: digest of the 2 ** k blocks that end here, or of all where there are fewer
    reach = 1
    while reach <= most:
        earlier = state.df.select("conv_id", (F.col("block") + reach).alias("block"), F.col("run").alias("earlier"))
        new = state.df.join(earlier, ["conv_id", "block"], "left")
        new = Stored(new.select("conv_id", "block", F.when(F.col("earlier").isNull(), F.col("run")).otherwise(_joined("earlier", "run")).alias("run")), "runs")
        state.drop()
        state, reach = new, reach * 2
    none = F.lit(None).cast("binary")
    both = state.df.select("conv_id", "block", none.alias("before"), F.col("run").alias("upto")).unionByName(state.df.select("conv_id", (F.col("block") + 1).alias("block"), F.col("run").alias("before"), none.alias("upto")))
    return both.groupBy("conv_id", "block").agg(F.max("before").alias("before"), F.max("upto").alias("upto")).where("block > 0")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """node, n_leaves, saved_tokens: sums over every subtree, by pointer jumping over nodes (node, parent: null at the top, leaf, saved)."""
    state = Stored(nodes.select("node", F.col("parent").alias("to"), F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens")), "rollup")
    while True:
        moving = state.df.where("to is not null")
        sums = Stored(moving.groupBy(F.col("to").alias("node")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"), F.count(F.lit(1)).alias("n")), "sums")
        if sums.df.isEmpty():
            return state.df.drop("to")
        hot = hot_keys(sums.df, "node", "n")
        jump = state.df.select(F.col("node").alias("to"), F.col("to").alias("next"))
        jumped = hot_join(moving, jump, "to", hot.withColumnRenamed("node", "to")).select("node", F.col("next").alias("to"), "n_leaves", "saved_tokens")
        resting = state.df.where("to is null")
        added = jumped.unionByName(resting).join(sums.df.drop("n"), "node", "left")
        leaves, saved = F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0)), F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))
        new = Stored(added.select("node", "to", leaves.cast("long").alias("n_leaves"), saved.cast("long").alias("saved_tokens")), "rollup")
        for old in (state, sums):
            old.drop()
        state = new


def end_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: digest of the ids (column conv_id) that end at each node, ascending and joined by commas."""
    order = ["node", "conv_id"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece, held, node = TaskContext.get().partitionId(), 0, [], None

        def pieces(nodes: list, texts: list):
            k = range(piece, piece + len(nodes))
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([part] * len(nodes), pa.int32()), pa.array(k, pa.int64()), pa.array(texts, pa.string())], ["node", "part", "piece", "ids"])

        for batch in batches:
            nodes, texts = [], []
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (key != node or len(held) >= PIECE_IDS):
                    nodes.append(node)
                    texts.append(",".join(held))
                    held = []
                node = key
                held.append(str(conv))
            if nodes:
                yield pieces(nodes, texts)
                piece += len(nodes)
        if held:
            yield pieces([node], [",".join(held)])

    dealt = ends.select("node", "conv_id").repartitionByRange(*order).sortWithinPartitions(*order)
    made = materialize(dealt.mapInArrow(join, "node binary, part int, piece long, ids string"), "ends")
    several = materialize(made.groupBy("node").count().where("count > 1").select("node"), "several")
    single = made.join(several, "node", "left_anti").select("node", F.sha2("ids", 256).alias("ends_sha256"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, None
        for batch in batches:
            done = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if running is not None and key == node:
                    running.update(b",")
                else:
                    if running is not None:
                        done.append((node, running.hexdigest()))
                    node, running = key, hashlib.sha256()
                running.update(text.encode())
            if done:
                yield _digests(done)
        if running is not None:
            yield _digests([(node, running.hexdigest())])

    # PIECE_IDS ids a row; a task holds one batch of rows and a running digest
    ordered = made.join(several, "node", "left_semi").repartition("node").sortWithinPartitions("node", "part", "piece").select("node", "ids")
    return single.unionByName(ordered.mapInArrow(digest, "node binary, ends_sha256 string"))


def _digests(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], ["node", "ends_sha256"])


def prefix_trie(turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 - one row per node."""
    rows, convs = rebuilt(turns)
    rows = materialize(named(rows), "named")
    nodes = rows.groupBy("node").agg(F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.first("pos").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.first("bytes").alias("bytes"))
    nodes = materialize(nodes, "nodes")
    inner = nodes.where("depth > 1")  # those of depth 1 hang on the root
    children = Stored(inner.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children")), "children").df
    counted = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    counted = materialize(counted, "counted")
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("bytes")
    sums = materialize(rolled_up(counted.select("node", F.when(F.col("depth") > 1, F.col("parent")).alias("parent"), leaf.alias("leaf"), saved.alias("saved"))), "sums")
    above = counted.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    hung = hot_join(counted.where("depth > 1"), above, "parent", hot_keys(children.withColumnRenamed("node", "parent"), "parent", "n_children"))
    first, n_convs = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    hung = hung.unionByName(counted.where("depth = 1").withColumn("parent_conv_id", F.lit(first).cast("long")))
    columns = ["node", "parent_conv_id", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    whole = hung.join(sums, "node").select(*columns)
    if n_convs:
        fan, leaves, saved = sums.join(counted.where("depth = 1"), "node", "left_semi").agg(F.count(F.lit(1)), F.sum("n_leaves"), F.sum("saved_tokens")).first()
        root = [(_ROOT, None, first, 0, n_convs, fan, leaves or 1, saved or 0)]
        whole = whole.unionByName(turns.sparkSession.createDataFrame(root, "node binary, parent_conv_id long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long"))
    ends = rows.where("ends").select("node", "conv_id").unionByName(convs.where("n = 0").select(F.lit(_ROOT).alias("node"), "conv_id"))
    out = whole.join(end_digests(ends), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


ORACLE_SQL = r"""
with own as (
  select conv_id, row_number() over (partition by conv_id order by turn asc nulls first, digest) as pos, digest, bytes
  from (
    select conv_id, turn, strlen(coalesce(text, '')) as bytes,
           sha256(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as digest
    from conversations where conv_id is not null
  )
), sized as (
  select conv_id, max(pos) as own_n, conv_id - conv_id % 5 as base,
         xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(conv_id::varchar, ''), lambda s: ascii(s)::bigint)),
             lambda acc, b: list_reduce(list_concat([xor(acc, b)], range(8)),
               lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295) % 9 as h
  from own group by conv_id
), convs as (
  select c.*, least(c.h, coalesce(b.own_n, 0)) as taken
  from sized c left join sized b on b.conv_id = c.base
), turns as (
  select c.conv_id, o.pos - c.h + c.taken as pos, o.digest, o.bytes from convs c join own o on o.conv_id = c.conv_id and o.pos > c.h
  union all
  select c.conv_id, o.pos, o.digest, o.bytes from convs c join own o on o.conv_id = c.base and o.pos <= c.taken
), paths as (
  select conv_id, pos, bytes, count(*) over (partition by conv_id) as n,
         sha256(string_agg(digest, ',') over (partition by conv_id order by pos rows between unbounded preceding and current row)) as node
  from turns
  union all
  select c.conv_id, 0, 0, (select count(*) from turns t where t.conv_id = c.conv_id), '' from convs c
), nodes as (
  select node, any_value(pos) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes,
         sha256(coalesce(string_agg(case when pos = n then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256
  from paths group by node
), placed as (
  select n.*, p.node as parent
  from nodes n left join paths p on p.conv_id = n.conv_id and p.pos = n.depth - 1
), fanned as (
  select p.*, (select count(*) from placed c where c.parent = p.node) as n_children from placed p
), above as (
  select a.node, sum(case when f.n_children = 0 then 1 else 0 end) as n_leaves, sum((f.n_convs - 1) * f.bytes) as saved_tokens
  from fanned f join paths a on a.conv_id = f.conv_id and a.pos <= f.depth
  group by a.node
)
select f.conv_id, f.depth::bigint as depth, q.conv_id as parent_conv_id, f.n_convs::bigint as n_convs, f.n_children::bigint as n_children,
       a.n_leaves::bigint as n_leaves, a.saved_tokens::bigint as saved_tokens, f.ends_sha256
from fanned f join above a on a.node = f.node left join nodes q on q.node = f.parent
"""
