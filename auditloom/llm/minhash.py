"""Near-duplicate groups by one-permutation hashing with optimal densification.

Each text's set of five-word shingles gives one sketch: a single hash deals the
shingles to bins, every bin keeps its least value, and an empty bin copies the
first filled bin of its own fixed random order.  Bands of the sketch are bucket
keys.  In a bucket, candidate edges run from a centre, the member that shares most
buckets with most others, to the other members (a star); every candidate is
confirmed on the full sets.  Members that are then in one component need no further
test.  For every other member the rest of its links is found exactly: two linked
sets share one of their rarest shingles (how many must be looked at follows from
both sizes), so these members meet all members of their buckets by rare shingles,
and what they meet is confirmed as well.  No link between members of a bucket is
lost, and no group is compared pair by pair.

Shingles are compared by 64-bit hashes under a key that is drawn for each run, so no
text can be made to collide.  Texts with the same set are one node.  The threshold is a parameter; the number of
bands of 4 rows follows from it (25 at 85 percent, 35 at 80), so that two texts just
at the threshold share no bucket with a probability of about 1e-8; such a pair, if
nothing else links its texts, is the only link that can be lost.

Hot keys (a bucket, centre, component or shingle with a large share of all rows) are
cut into parts or met by a broadcast of at most ``runtime.HOT`` rows.

Defined cases: null, empty and blank texts have no shingles and are linked with
nothing; with fewer than five words the whole sequence is the one shingle; texts of
any length are read whole, one at a time; rows that repeat an id stand in one
component if their sets are linked, and share that id; rows with null id follow their
component's smallest id (null if it has none); of two members that share equally many
buckets the one with the larger node name is the centre; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import LOWER, NOT_SPACE, Stored, Words, hot_join, hot_keys, list_column, materialize, mix, new_key, salted_join, slices, text_buffer

SHINGLE_WORDS = 5
#: Linked if 100 * intersection >= percent * union; this is op2's percent.
PERCENT = 85
ROWS = 4
#: Probability that two texts just at the threshold share no bucket, at most.
MISS = 1e-8
_MANY = np.uint64(0xFFFFFFFFFFFFFFFF)


def bands_for(percent: int) -> int:
    """The least number of bands that keeps to MISS."""
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS)))


@lru_cache
def _order(bins: int) -> np.ndarray:
    """The order of each bin in which an empty one looks for a donor."""
    return np.random.default_rng(20240229).permuted(np.tile(np.arange(bins), (bins, 1)), axis=1)


def shingle_sets(column: pa.Array, k: int = SHINGLE_WORDS, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (by a key) of the distinct shingles of each text, ascending within a text, and their number."""
    raw, offsets = text_buffer(column)
    words = Words(LOWER[raw], offsets, NOT_SPACE)
    n = len(words.counts)
    hashed = words.hashes(key=key)
    grams, counts = words.grams(hashed, k)
    doc = np.repeat(np.arange(n), counts)
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        whole = np.array([_chain(hashed[words.doc[i] : words.doc[i + 1]]) for i in short], dtype=np.uint64)
        doc, grams = np.concatenate([doc, short]), np.concatenate([grams, whole])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    first = np.ones(len(doc), dtype=bool)
    first[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    return grams[first], np.bincount(doc[first], minlength=n)


def _chain(hashed: np.ndarray) -> np.uint64:
    """Hash of a short sequence of words as one shingle."""
    out = np.array([len(hashed)], dtype=np.uint64)
    for i in range(len(hashed)):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashed[i : i + 1])
    return out[0]


def sketches(sets: np.ndarray, counts: np.ndarray, bands: int = bands_for(PERCENT)) -> np.ndarray:
    """One-permutation sketch of each set, without empty bins (rows of empty sets have no meaning)."""
    n, bins, order_of = len(counts), bands * ROWS, _order(bands * ROWS)
    doc = np.repeat(np.arange(n), counts)
    value = mix(sets ^ np.uint64(0x2545F4914F6CDD1D))
    cell = doc * bins + (((value >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    out = np.full(n * bins, _MANY)
    order = np.argsort(value)[::-1]
    out[cell[order]] = value[order]  # the last one written, the least, stays
    out = out.reshape(n, bins)
    filled = out != _MANY
    for i in np.flatnonzero((counts > 0) & ~filled.all(axis=1)):
        empty = np.flatnonzero(~filled[i])
        donor = order_of[empty, np.argmax(filled[i][order_of[empty]], axis=1)]
        out[i, empty] = out[i, donor]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """Bucket keys: one per band."""
    bands = sketch.shape[1] // ROWS
    rows = sketch.reshape(len(sketch), bands, ROWS)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), rows.shape[:2])
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return key


def set_names(sets: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """A 128-bit name of each set, None for the empty set."""
    ends = np.cumsum(counts)
    sums = []
    for salt in (0x94D049BB133111EB, 0xBF58476D1CE4E5B9):
        total = np.zeros(len(sets) + 1, dtype=np.uint64)
        np.cumsum(mix(sets + np.uint64(salt)), out=total[1:])
        sums.append(mix(total[ends] - total[ends - counts] + counts.astype(np.uint64)))
    packed = np.stack(sums, axis=1).astype(">u8")
    return [row.tobytes() if n else None for row, n in zip(packed, counts, strict=True)]


def sketched(docs: DataFrame, bands: int, key: int = 0) -> DataFrame:
    """doc_id, text_key (tells rows of one id apart), n_shingles, node (name of the set), keys (bucket keys; empty without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                sets, counts = shingle_sets(part.column(2), key=key)
                keys = band_keys(sketches(sets, counts, bands))
                per_text = np.where(counts > 0, bands, 0)
                keys = list_column(np.ascontiguousarray(keys[counts > 0]).ravel(), per_text)
                names = pa.array(set_names(sets, counts), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64()), names, keys], ["doc_id", "text_key", "n_shingles", "node", "keys"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, n_shingles long, node binary, keys array<long>")


def representatives(rows: DataFrame) -> DataFrame:
    """node, rep, rep_key (the row with the smallest id, null only if all are, that stands for it), n (size of its set), keys, n_rows."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    found = rows.groupBy("node").agg(F.min(order).alias("r"), F.first("n_shingles").cast("int").alias("n"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("n_rows"))
    return found.select("node", F.col("r.doc_id").alias("rep"), F.col("r.text_key").alias("rep_key"), "n", "keys", "n_rows")


def full_sets(docs: DataFrame, nodes: DataFrame, key: int = 0) -> DataFrame:
    """node, shingles of the nodes given (columns node, rep, rep_key), from the texts of their representatives."""
    wanted = nodes.select("rep", "rep_key", F.col("node").alias("wanted")).hint("merge")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    rows = rows.join(wanted, (F.col("text_key") == F.col("rep_key")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("wanted", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                sets, counts = shingle_sets(part.column(1), key=key)
                right = np.array([a == b for a, b in zip(part.column(0).to_pylist(), set_names(sets, counts), strict=True)], dtype=bool)
                kept = sets[np.repeat(right, counts)]
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(right)), list_column(kept, counts[right])], ["node", "shingles"])

    return rows.mapInArrow(run, "node binary, shingles array<long>").dropDuplicates(["node"])


def _counted(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))


def confirm(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose full sets are similar enough."""
    edges = materialize(edges.select("a", "b"), "edges")
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - both
    found = salted_join(edges, left, "a", hot_keys(_counted(edges, "a"), "a", "n_rows"), "b")
    found = salted_join(found, right, "b", hot_keys(_counted(edges, "b"), "b", "n_rows"), "a")
    return found.where(both * 100 >= union * percent).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, root: connected components by alternating large and small stars; root is the least node of each."""
    star = Stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    while not _are_stars(star.df):
        both = star.df.unionByName(star.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = Stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        large = hot_join(both, least.df.drop("n"), "u", hot_keys(least.df, "u", "n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = Stored(large, "large")
        low = Stored(large.df.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "low")
        small = hot_join(large.df, low.df.drop("n"), "u", hot_keys(low.df, "u", "n")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = Stored(small.unionByName(low.df.select("u", F.col("m").alias("v"))).distinct(), "stars")
        for old in (star, least, large, low):
            old.drop()
        star = new
    return star.df.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v only and no v is a u, so that each component is one star."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept - one row per input row."""
    return grouped(docs, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def grouped(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, root (null without shingles), component_id - one row per input row."""
    key = new_key()  # shingles are told apart by a hash that no text can be made for
    rows = materialize(sketched(docs, bands_for(percent), key), "sketches")
    nodes = materialize(representatives(rows.where("node is not null")), "nodes")
    members = materialize(bucket_members(nodes), "members")
    sets = materialize(full_sets(docs, nodes.select("node", "rep", "rep_key").join(members.select("node").distinct(), "node", "left_semi"), key), "sets")
    star = members.where("node <> centre").select("centre", "node", "n", "centre_n").distinct().where(_near_in_size("n", "centre_n", percent))
    links = materialize(confirm(star.select(F.col("centre").alias("a"), F.col("node").alias("b")), sets, percent), "links")
    labels = components(links)
    rest = rare_pairs(members, labels, sets, percent)
    if rest is not None:
        rest = materialize(confirm(rest, sets, percent), "links")
        if not rest.isEmpty():
            labels = components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest))
    found = materialize(nodes.select("node", "rep").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")), "found")
    least = materialize(found.groupBy("root").agg(F.min("rep").alias("component"), F.count(F.lit(1)).alias("n")), "roots")
    of_node = hot_join(found, least.drop("n"), "root", hot_keys(least, "root", "n")).select("node", "root", "component")
    hot = hot_keys(nodes, "node", "n_rows")
    out = hot_join(rows.where("node is not null").drop("keys"), materialize(of_node, "of_node"), "node", hot)
    blank = rows.where("node is null").withColumns({"root": F.lit(None).cast("binary"), "component": F.col("doc_id")})
    columns = ["doc_id", "text_key", "n_shingles", "root", F.col("component").alias("component_id")]
    return out.select(*columns).unionByName(blank.select(*columns))


def bucket_members(nodes: DataFrame) -> DataFrame:
    """key, node, n, centre, centre_n of the buckets with several members."""
    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    sizes = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "sizes")
    hot = hot_keys(sizes, "key", "m")
    several = materialize(hot_join(keyed, sizes, "key", hot), "buckets")
    shared = several.groupBy("node").agg(F.sum("m").alias("shared"))
    centres = several.join(shared, "node").groupBy("key").agg(F.max(F.struct("shared", "node", "n")).alias("c"))
    centres = materialize(centres.select("key", F.col("c.node").alias("centre"), F.col("c.n").alias("centre_n")), "centres")
    return hot_join(several.drop("m"), centres, "key", hot)


def rare_pairs(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """a, b: every pair that may be linked of a member outside its bucket's main component and a member of such a bucket, in different components (None if no member is outside)."""
    of_centre = labels.select(F.col("node").alias("centre"), F.col("root").alias("centre_root"))
    rooted = hot_join(members.join(labels, "node", "left"), of_centre, "centre", hot_keys(_counted(members, "centre"), "centre", "n_rows"), "left")
    rooted = rooted.select("key", "node", F.coalesce("root", "node").alias("root"), F.coalesce("centre_root", "centre").alias("centre_root"))
    rooted = materialize(rooted, "rooted")
    apart = rooted.where("root <> centre_root").select("key", "node")
    if apart.isEmpty():
        return None
    probes = apart.select("node").distinct().withColumn("probe", F.lit(True))
    keys = materialize(apart.select("key").distinct(), "apart")
    near = hot_join(rooted, keys, "key", hot_keys(_counted(rooted, "key"), "key", "n_rows"), "left_semi").select("node", "root").distinct()
    near = near.join(probes, "node", "left")
    entries = materialize(rare_entries(near.join(sets, "node"), percent), "rare")
    probe = entries.where("probe").select("w", F.col("own").alias("c"), F.col("other").alias("d"), F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"))
    right = entries.select("w", F.col("other").alias("c"), F.col("own").alias("d"), "node", "root", "n")
    pairs = probe.join(right, ["w", "c", "d"]).where((F.col("root") != F.col("ra")) & _near_in_size("n", "na", percent))
    return pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


#: Sizes in one class differ by 2 percent.
_CLASS_STEP = 1.02


def classes_apart(percent: int) -> int:
    """Linked sets are at most so many size classes apart."""
    return math.ceil(math.log(100 / percent) / math.log(_CLASS_STEP))


def rare_entries(rows: DataFrame, percent: int) -> DataFrame:
    """w, own, other, node, root, n, probe: the rarest shingles of each set (by which it can meet sets of each size class), those of one set alone left out.

    Sets of sizes x and y are linked only if they share (percent / (100 + percent)) (x + y)
    shingles, so the first one they share, in order of rarity, is early in both.
    """
    apart = classes_apart(percent)
    sized = materialize(rows.withColumn("n", F.size("shingles")), "sized")
    each = sized.select("node", F.explode("shingles").alias("w"))
    often = materialize(each.groupBy("w").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "often")
    listed = hot_join(each, often, "w", hot_keys(often, "w", "df")).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("shared"))
    own = F.floor(F.log(F.col("n")) / F.log(F.lit(_CLASS_STEP))).cast("int")
    ranked = sized.drop("shingles").join(listed, "node").withColumn("own", own)
    ranked = ranked.withColumn("other", F.explode(F.sequence(F.col("own") - apart, F.col("own") + apart)))
    least = F.greatest(F.floor(F.pow(F.lit(_CLASS_STEP), F.col("other"))) - 1, F.ceil(F.col("n") * percent / 100), F.lit(1))
    need = F.ceil((F.col("n") + least) * percent / (100 + percent) - 1e-6)
    first = F.col("n") - F.size("shared")  # shingles of this set alone come first
    take = F.greatest(F.lit(0), F.col("n") - need + 1 - first).cast("int")
    ranked = ranked.where(take > 0).withColumn("take", F.explode(F.slice("shared", 1, take)))
    return ranked.select(F.col("take.w").alias("w"), "own", "other", "node", "root", "n", "probe")


def _near_in_size(a: str, b: str, percent: int):
    """Sets whose sizes alone do not rule a link out."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group: that with the smallest id, of rows that repeat this id the one with the least text key.  Rows without shingles all stay."""
    found = materialize(grouped(docs, percent).where("root is not null").select("root", F.col("doc_id").alias("__i"), F.col("text_key").alias("__k")), "groups")
    order = F.struct(F.col("__i").isNull().alias("last"), "__i", "__k")
    stays = found.groupBy("root").agg(F.min(order).alias("s"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", F.col("s.__i").alias("si"), F.col("s.__k").alias("sk"), "n")
    stays = materialize(stays, "stays")
    stay = F.col("__i").eqNullSafe(F.col("si")) & (F.col("__k") == F.col("sk"))
    several = hot_join(found, stays.drop("n"), "root", hot_keys(stays, "root", "n")).withColumn("stays", stay).select("__i", "__k", "stays")
    several = materialize(several, "several")
    marked = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__key": F.xxhash64(F.coalesce("text", F.lit("")))})
    same = F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__key") == F.col("__k"))
    left = marked.join(several.where("not stays").select("__i", "__k").distinct(), same, "left_anti")
    tied = several.where("stays").groupBy("__i", "__k").count().where("count > 1")
    if not tied.isEmpty():
        left = left.join(tied, same, "left_anti").unionByName(left.join(tied, same, "left_semi").dropDuplicates(["__id", "__key"]))
    return left.drop("__id", "__key")
