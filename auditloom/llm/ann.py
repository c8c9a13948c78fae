"""Approximate nearest neighbours by cosine: NN-descent builds a graph, queries search it greedily.

Vectors that are equal are one node.  The graph starts from blocks of nodes next to
each other in orders of random hyperplane signs; each round then joins every node's
neighbours and reverse neighbours with each other (neighbours of neighbours) and
keeps the nearest, until a round changes next to nothing.  All queries walk the graph
together: each starts from its own node (if it is indexed), from a fixed number of
pivots and what these are linked to, and always expands the nearest nodes of its beam
that are not expanded yet.  A step deals the nodes to expand out to the buckets of
the links, so its work is that of queries times FAN, and no step reads the links more
than once.  The best of the beam, and all that tie with the k-th within the codes'
error, are ranked again by the exact cosine.

Distances within the walk are of single-precision unit vectors; results never are.
Where their error leaves open whether a node that is not ranked, or not in a full
beam, belongs to the k nearest, the query is compared with all rows.

Defined cases: vectors that are null, zero, hold null or non-finite components, or
differ in length from the most common length take no part, as query or candidate;
rows that repeat id and vector are one; a query's own id is never its result; ties
go to the smaller id, null ids last; an empty table gives an empty result.  Queries
that the walk leaves with fewer results than there are candidates, or in doubt, are
answered by comparing them, in blocks, with all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import Stored, list_column, materialize, partitions_for, scratch

#: Neighbours and reverse neighbours of a node; partners that one join proposes to a node.
NEIGHBOURS, REVERSE, PROPOSALS = 20, 14, 6
#: The descent ends when a round changes less than this share of all neighbours, or after so many rounds.
LEAST_CHANGE, MOST_DESCENTS = 0.05, 12
#: Orders of the start and nodes compared in a block of one.
ORDERS, BLOCK, SIGN_BITS = 3, 128, 20
#: Nodes in a beam, nodes expanded at once, pivots, nodes kept of what these are linked to, beam nodes ranked again at least.
BEAM, FAN, PIVOTS, ENTRIES, RERANK = 800, 128, 32, 128, 64
#: Nodes in one bucket of the links; queries compared with all rows together.
BUCKET_NODES, QUERY_BLOCK = 10_000, 512
#: Rows with up to hundreds of nodes (some 10 to 60 KB each) that a scan or a Python worker takes at once; pairs that it gathers before it sends them on; bytes of a row group of the links.
WIDE_ROWS, PAIRS_AT_ONCE, ROW_GROUP = 256, 1 << 19, 4 << 20


@contextmanager
def wide_rows(spark: SparkSession):
    """Within it scans and Python workers take at most WIDE_ROWS rows at once; by Spark's limits (4,096 and 10,000) that would be up to 100 MB of links a task."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")}
    for key, rows in before.items():
        spark.conf.set(key, min(WIDE_ROWS, int(rows)) if int(rows) > 0 else WIDE_ROWS)
    try:
        yield
    finally:
        for key, rows in before.items():
            spark.conf.set(key, rows)


def _matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """Rows of a list column of one length."""
    flat = np.asarray(column.flatten(), dtype=kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _codes(column: pa.Array) -> np.ndarray:
    """Unit vectors from their single-precision bytes, read where they lie (all have one length, none is null)."""
    if not len(column):
        return np.zeros((0, 0), np.float32)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].view("<f4").reshape(len(column), -1)


def valid_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vector (doubles), node: the rows that take part."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    length = common[0]["n"] if common else 0
    return rows.where(F.size("vector") == length).distinct().withColumn("node", F.xxhash64("vector"))


def _coded(nodes: DataFrame) -> DataFrame:
    """node, code: single-precision unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["node", "code"])

    return nodes.select("node", "vector").mapInArrow(run, "node long, code binary")


_PAIRS = "node long, other long, sim float"


def _pair_batch(a, b, s) -> pa.RecordBatch:
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
    return pa.RecordBatch.from_arrays([pa.array(join(a, np.int64)), pa.array(join(b, np.int64)), pa.array(join(s, np.float32))], ["node", "other", "sim"])


def _nearest(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest entries above -2 of every row."""
    k = min(k, sims.shape[1])
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.broadcast_to(np.arange(k), sims.shape)
    good = np.take_along_axis(sims, at, 1) > -2
    return np.repeat(np.arange(len(sims)), k).reshape(len(sims), k)[good], at[good]


def start_pairs(nodes: DataFrame) -> DataFrame:
    """node, other, sim: nearest nodes within blocks of several random orders."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(SIGN_BITS, dtype=np.int64)
        for batch in batches:
            x = _codes(batch.column(1))
            for order in range(ORDERS):
                planes = np.random.default_rng(order).standard_normal((x.shape[1], SIGN_BITS))
                signature = (x @ planes > 0) @ weights
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([order] * len(x), pa.int32()), pa.array(signature)], ["node", "code", "ordering", "signature"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x, order = batch.column(0).to_numpy(), _codes(batch.column(1)), batch.column(2).to_numpy()
            a, b, s = [], [], []
            for at in range(0, len(x), BLOCK):
                own = slice(at, at + BLOCK)
                sims = x[own] @ x[own].T
                sims[(order[own][:, None] != order[own]) | (ids[own][:, None] == ids[own])] = -9
                i, j = _nearest(sims, NEIGHBOURS)
                a.append(ids[own][i])
                b.append(ids[own][j])
                s.append(sims[i, j])
            yield _pair_batch(a, b, s)

    signed = nodes.mapInArrow(sign, "node long, code binary, ordering int, signature long")
    n = nodes.sparkSession.sparkContext.defaultParallelism
    return signed.repartitionByRange(n, "ordering", "signature", "node").sortWithinPartitions("ordering", "signature", "node").mapInArrow(compare, _PAIRS)


def _merged_lists(rows: np.ndarray, ids: np.ndarray, sims: np.ndarray, old: np.ndarray, n_rows: int, k: int):
    """Distinct ids of each row, nearest first, at most k: (ids, sims, old, counts); of equal ids an old one stays."""
    order = np.lexsort((~old, ids, rows))
    rows, ids, sims, old = rows[order], ids[order], sims[order], old[order]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])
    rows, ids, sims, old = rows[first], ids[first], sims[first], old[first]
    order = np.lexsort((ids, -sims, rows))
    rows, ids, sims, old = rows[order], ids[order], sims[order], old[order]
    start = np.searchsorted(rows, np.arange(n_rows))
    keep = np.arange(len(rows)) - start[rows] < k
    return ids[keep], sims[keep], old[keep], np.bincount(rows[keep], minlength=n_rows)


def _cut(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows, as each row may hold hundreds of nodes."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row number of each element of a list column (null lists as empty), and the elements."""
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(False).astype(np.int64)
    return np.repeat(np.arange(len(column)), counts), column.flatten()


_GRAPH = "node long, code binary, ids array<long>, sims array<float>, old array<boolean>, least float"


def _graph_step(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Graph rows with the pairs taken in; nodes: node, code, ids, sims, old (entries present are old afterwards)."""
    offered = pairs.groupBy("node").agg(F.collect_list("other").alias("new_ids"), F.collect_list("sim").alias("new_sims"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            r0, i0 = _flat(batch.column(2))
            _, s0 = _flat(batch.column(3))
            r1, i1 = _flat(batch.column(4))
            _, s1 = _flat(batch.column(5))
            old = np.concatenate([np.ones(len(r0), bool), np.zeros(len(r1), bool)])
            ids = np.concatenate([i0.to_numpy(False), i1.to_numpy(False)]).astype(np.int64)
            sims = np.concatenate([s0.to_numpy(False), s1.to_numpy(False)]).astype(np.float32)
            ids, sims, old, counts = _merged_lists(np.concatenate([r0, r1]), ids, sims, old, n, NEIGHBOURS)
            offsets = np.concatenate([[0], np.cumsum(counts)])
            least = np.full(n, -2, dtype=np.float32)
            full = counts == NEIGHBOURS
            least[full] = sims[offsets[1:][full] - 1]
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for x in (ids, sims, old)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, pa.array(least)], ["node", "code", "ids", "sims", "old", "least"])

    return nodes.select("node", "code", "ids", "sims").join(offered, "node", "left").mapInArrow(merge, _GRAPH)


def _around(graph: DataFrame, seed: int) -> DataFrame:
    """at, node, old: each node's neighbours, and a sample of those it is a neighbour of."""
    forward = graph.select(F.col("node").alias("at"), F.explode(F.arrays_zip("ids", "old")).alias("e")).select("at", F.col("e.ids").alias("node"), F.col("e.old").alias("old"))
    back = forward.select(F.col("node").alias("at"), F.col("at").alias("node"), "old")
    place = F.row_number().over(Window.partitionBy("at").orderBy("old", F.xxhash64("node", F.lit(seed))))
    return forward.unionByName(back.withColumn("place", place).where(F.col("place") <= REVERSE).drop("place"))


def _descend(graph: DataFrame, seed: int) -> DataFrame:
    """node, other, sim: pairs of neighbours of a common node that are nearer than what they have."""
    members = _around(graph, seed).join(graph.select("node", "code", "least"), "node")
    sets = members.groupBy("at").agg(*[F.collect_list(c).alias(c) for c in ("node", "old", "least", "code")])

    def local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, s = [], [], []
        gathered = 0
        for batch in batches:
            counts = pc.list_value_length(batch.column(1)).to_numpy(False)
            ends = np.cumsum(counts)
            ids, old = batch.column(1).flatten().to_numpy(False), batch.column(2).flatten().to_numpy(False)
            least, x = batch.column(3).flatten().to_numpy(False), _codes(batch.column(4).flatten())
            for lo, hi in zip((ends - counts).tolist(), ends.tolist(), strict=True):
                own, m = ids[lo:hi], x[lo:hi]
                sims = m @ m.T
                sims[(own[:, None] == own) | (old[lo:hi, None] & old[lo:hi]) | (sims <= least[lo:hi, None])] = -9
                i, j = _nearest(sims, PROPOSALS)
                a.append(own[i])
                b.append(own[j])
                s.append(sims[i, j])
                gathered += len(i)
            if gathered >= PAIRS_AT_ONCE:
                yield _distinct(_pair_batch(a, b, s))
                a, b, s = [], [], []
                gathered = 0
        if gathered:
            yield _distinct(_pair_batch(a, b, s))

    return sets.mapInArrow(local_join, _PAIRS)


def _distinct(batch: pa.RecordBatch) -> pa.RecordBatch:
    a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    order = np.lexsort((b, a))
    first = np.ones(len(a), dtype=bool)
    first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    return batch.take(pa.array(order[first]))


def build_graph(nodes: DataFrame) -> DataFrame:
    """Neighbour graph (node, code, ids, sims, old, least) by NN-descent from block starts."""
    bare = nodes.withColumns({"ids": F.array().cast("array<long>"), "sims": F.array().cast("array<float>")})
    graph = Stored(_graph_step(bare, start_pairs(nodes)), "graph")
    for i in range(MOST_DESCENTS):
        new = Stored(_graph_step(graph.df, _descend(graph.df, i)), "graph")
        graph.drop()
        graph = new
        _release(nodes)
        changed, total = graph.df.agg(F.sum(F.size(F.filter("old", lambda x: ~x))), F.sum(F.size("old"))).first()
        if not total or changed < LEAST_CHANGE * total:
            break
    return graph.df


def _release(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of steps that are written and no longer referred to."""
    import gc

    gc.collect()
    df.sparkSession._jvm.System.gc()


def adjacency(graph: DataFrame, buckets: int) -> DataFrame:
    """node, ids, codes: what a walk sees from a node - neighbours and reverse neighbours with their codes; dealt to ``buckets`` partitions by node."""
    edges = _around(graph, MOST_DESCENTS).select("at", "node").distinct().join(graph.select("node", "code"), "node")
    dealt = edges.select(F.col("at").alias("node"), F.col("node").alias("other"), "code").repartition(buckets, "node")
    return dealt.groupBy("node").agg(F.collect_list("other").alias("ids"), F.collect_list("code").alias("codes"))


class Links:
    """The adjacency as a table bucketed by node in the shared folder: joins by node do not move it."""

    def __init__(self, graph: DataFrame, n_nodes: int):
        self.spark = graph.sparkSession
        self.name = f"auditloom_links_{uuid.uuid4().hex}"
        buckets = partitions_for(self.spark, n_nodes, BUCKET_NODES)
        adjacency(graph, buckets).write.format("parquet").bucketBy(buckets, "node").option("parquet.block.size", ROW_GROUP).option("path", scratch(self.spark, "links")).saveAsTable(self.name)
        self.df = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")


# ---------------------------------------------------------------------------
# Search.

_STATE = "q long, code binary, ids array<long>, sims array<float>, done array<boolean>, front array<long>, least float"


def _advance(state: DataFrame, offers: DataFrame | None, beam: int) -> DataFrame:
    """Take offers (q, other, sim) into the beams and choose what to expand next."""
    columns = ["q", "code", "ids", "sims", "done"]
    if offers is None:
        joined = state.select(*columns, F.array().cast("array<long>").alias("new_ids"), F.array().cast("array<float>").alias("new_sims"))
    else:
        offered = offers.groupBy("q").agg(F.collect_list("other").alias("new_ids"), F.collect_list("sim").alias("new_sims"))
        joined = state.select(*columns).join(offered, "q", "left")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches, 100):
            n = batch.num_rows
            parts = [_flat(batch.column(c)) for c in range(2, 7)]
            rows = np.concatenate([parts[0][0], parts[3][0]])
            ids = np.concatenate([parts[0][1].to_numpy(False), parts[3][1].to_numpy(False)]).astype(np.int64)
            sims = np.concatenate([parts[1][1].to_numpy(False), parts[4][1].to_numpy(False)]).astype(np.float32)
            done = np.concatenate([parts[2][1].to_numpy(False).astype(bool), np.zeros(len(parts[3][0]), bool)])
            ids, sims, done, counts = _merged_lists(rows, ids, sims, done, n, beam)
            row = np.repeat(np.arange(n), counts)
            waiting = np.cumsum(~done)
            before = np.concatenate([[0], waiting])[(np.cumsum(counts) - counts)]
            front = ~done & (waiting - before[row] <= FAN)
            done |= front
            offsets = np.concatenate([[0], np.cumsum(counts)])
            least = np.full(n, -2, dtype=np.float32)
            full = counts == beam
            least[full] = sims[offsets[1:][full] - 1]
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for x in (ids, sims, done)]
            out = [batch.column(0), batch.column(1), *lists, list_column(ids[front], np.bincount(row[front], minlength=n)), pa.array(least)]
            yield pa.RecordBatch.from_arrays(out, ["q", "code", "ids", "sims", "done", "front", "least"])

    return joined.mapInArrow(merge, _STATE)


def _expand(state: DataFrame, links: DataFrame) -> DataFrame:
    """q, other, sim: what the beams' front nodes see, as far as it can enter the beam."""
    front = state.select("q", F.col("code").alias("query"), "least", F.explode("front").alias("node"))
    # the front goes to the links' buckets and is the side that is held; the links stay where they are
    seen = links.join(front.hint("shuffle_hash"), "node").select("q", "query", "least", "ids", "codes")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches, 200):
            row, ids = _flat(batch.column(3))
            sims = np.einsum("ij,ij->i", _codes(batch.column(4).flatten()), _codes(batch.column(1))[row]) if len(row) else np.empty(0)
            good = sims > batch.column(2).to_numpy()[row] if len(row) else np.empty(0, bool)
            q = batch.column(0).to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(q[good], pa.int64()), pa.array(ids.to_numpy(False)[good], pa.int64()), pa.array(sims[good].astype(np.float32))], ["q", "other", "sim"])

    return seen.mapInArrow(score, "q long, other long, sim float")


def _entered(queries: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """q, code, ids, sims, done: where each query starts - its own node, the pivots (already expanded), and the nearest of what these see."""
    pivots = nodes.orderBy(F.xxhash64("node", F.lit(77)), "node").limit(PIVOTS)
    found = pivots.collect()  # PIVOTS rows
    seen = links.join(F.broadcast(pivots.select("node")), "node").collect()  # PIVOTS rows of at most NEIGHBOURS + REVERSE nodes
    own = np.array([p["node"] for p in found], dtype=np.int64)
    other = {i: c for r in seen for i, c in zip(r["ids"], r["codes"], strict=True)}
    for i in own.tolist():
        other.pop(i, None)
    ids = np.concatenate([own, np.array(list(other), dtype=np.int64)])
    codes = np.stack([np.frombuffer(c, "<f4") for c in [*[p["code"] for p in found], *other.values()]])

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches, 200):
            n = batch.num_rows
            sims = (_codes(batch.column(2)) @ codes.T).astype(np.float32)
            k = min(ENTRIES, len(ids) - len(own))
            near = np.argpartition(-sims[:, len(own) :], k - 1, axis=1)[:, :k] + len(own) if k else np.empty((n, 0), dtype=np.int64)
            place = np.column_stack([np.broadcast_to(np.arange(len(own)), (n, len(own))), near])
            all_ids = np.column_stack([batch.column(1).to_numpy(False), ids[place]])
            all_sims = np.column_stack([np.ones(n, np.float32), np.take_along_axis(sims, place, 1)])
            done = np.zeros(all_ids.shape, dtype=bool)
            done[:, 1 : len(own) + 1] = True
            rows = np.repeat(np.arange(n), all_ids.shape[1])
            i, s, d, counts = _merged_lists(rows, all_ids.ravel(), all_sims.ravel(), done.ravel(), n, all_ids.shape[1])
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (i, s, d)]], ["q", "code", "ids", "sims", "done"])

    return queries.select("q", "node", "code").mapInArrow(enter, "q long, code binary, ids array<long>, sims array<float>, done array<boolean>")


def _walk(queries: DataFrame, nodes: DataFrame, links: DataFrame, beam: int, k: int, error: float) -> DataFrame:
    """q, bound, node: the beam nodes to rank of each query (columns q, node, code); no other node seen is nearer than ``bound`` by its code."""
    state = Stored(_advance(_entered(queries, links, nodes), None, beam), "walk")
    while not state.df.where(F.size("front") > 0).isEmpty():
        new = Stored(_advance(state.df, _expand(state.df, links), beam), "walk")
        state.drop()
        state = new
    _release(queries)
    at = lambda i: F.coalesce(F.get("sims", F.lit(i)).cast("double"), F.lit(-9.0))
    cut = state.df.withColumn("cut", F.least(at(RERANK - 1), at(k) - 2 * error))
    left = F.array_max(F.filter("sims", lambda x: x < F.col("cut")))
    taken = F.filter(F.arrays_zip("ids", "sims"), lambda x: x["sims"] >= F.col("cut"))
    return cut.select("q", F.coalesce(left, "least").cast("double").alias("bound"), F.explode(taken).alias("e")).select("q", "bound", F.col("e.ids").alias("node"))


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of candidate pairs (q, query_id, query, vec_id, vector)."""

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = cosines(_matrix(batch.column(2)), _matrix(batch.column(4)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(scores)], ["q", "query_id", "vec_id", "score"])

    scored = pairs.select("q", "query_id", "query", "vec_id", "vector").mapInArrow(cosine, "q long, query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return scored.withColumn("rank", place).where(F.col("rank") <= k)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows in double precision."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def brute_force(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """q, query_id, rank, vec_id, score against all rows; queries (q, query_id, query) are taken in blocks."""
    spark, out = queries.sparkSession, None
    listed = queries.select("q").orderBy("q")
    for block in _blocks(listed, QUERY_BLOCK):
        own = queries.join(block, "q").collect()  # about QUERY_BLOCK queries
        keys, ids = np.array([r["q"] for r in own]), [r["query_id"] for r in own]
        wanted = np.array([r["query"] for r in own])

        def nearest(batches: Iterator[pa.RecordBatch], keys=keys, ids=ids, wanted=wanted) -> Iterator[pa.RecordBatch]:
            norms = np.sqrt((wanted * wanted).sum(axis=1))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, theirs = _matrix(batch.column(1)), batch.column(0).to_pylist()
                sims = (wanted @ x.T) / (norms[:, None] * np.sqrt((x * x).sum(axis=1)))
                last = max(0, len(x) - k - 1)
                least = np.partition(sims, last, axis=1)[:, last]
                # the margin keeps ties, which _ranked settles by id
                found = [(i, j) for i, j in np.argwhere(sims >= least[:, None] - 1e-12).tolist() if theirs[j] != ids[i]]
                columns = [pa.array([keys[i] for i, _ in found], pa.int64()), pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([theirs[j] for _, j in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["q", "query_id", "vec_id"])

        near = vectors.select("vec_id", "vector").mapInArrow(nearest, "q long, query_id long, vec_id long").distinct()
        pairs = near.join(vectors.select(F.col("vec_id").alias("v"), "vector"), F.col("vec_id").eqNullSafe(F.col("v")))
        pairs = pairs.join(F.broadcast(spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(keys, wanted, strict=True)], "q long, query array<double>")), "q")
        part = _ranked(pairs, k)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "q long, query_id long, vec_id long, score double, rank int")


def _blocks(keys: DataFrame, size: int) -> list[DataFrame]:
    """Disjoint blocks of about ``size`` keys (by hash)."""
    n = max(1, -(-keys.count() // size))
    return [keys.where(F.pmod(F.xxhash64("q"), F.lit(n)) == i) for i in range(n)] if n > 1 else [keys]


def nearest_neighbours(table: DataFrame, *, every: int = 50, k: int = 5, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is divisible by ``every``."""
    with wide_rows(table.sparkSession):
        return _found(table, every, k, beam)


def _found(table: DataFrame, every: int, k: int, beam: int) -> DataFrame:
    spark = table.sparkSession
    vectors = materialize(valid_vectors(table), "vectors")
    each = vectors.groupBy("node").agg(F.first("vector").alias("vector"))
    nodes = materialize(_coded(each), "codes")
    # a node's k + 1 smallest ids are all that a result can need
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.col("vec_id").asc_nulls_last()))
    members = vectors.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    queries = vectors.where(F.col("vec_id") % every == 0).select(F.xxhash64("vec_id", "node").alias("q"), F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), "node")
    queries = materialize(queries.join(nodes, "node"), "queries")
    empty = "query_id long, rank int, vec_id long, score double"
    if queries.isEmpty():
        return spark.createDataFrame([], empty)
    # a bound on the error of a sum of so many products in single precision
    error = (queries.select(F.size("query")).first()[0] + 4) * 2.0**-24
    graph = build_graph(nodes)
    links = Links(graph, nodes.count())
    found = materialize(_walk(queries, nodes, links.df, beam, k, error), "found")
    links.drop()
    pairs = found.drop("bound").join(queries.drop("node", "code"), "q").join(members, "node").where(~F.col("query_id").eqNullSafe(F.col("vec_id")))
    ranked = materialize(_ranked(pairs, k), "ranked")
    total = vectors.select("vec_id").distinct().count() - 1
    sure = ranked.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last")).join(found.select("q", "bound").distinct(), "q")
    sure = sure.where((F.col("n") >= min(k, total)) & (F.col("last") > F.col("bound") + error))
    short = queries.join(sure, "q", "left_anti")
    short = materialize(short.select("q", "query_id", "query"), "short")
    if not short.isEmpty():
        rest = brute_force(short, members, k)
        ranked = ranked.join(short.select("q"), "q", "left_anti").unionByName(rest)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
