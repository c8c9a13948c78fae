"""Toxicity by class-conditional Kneser-Ney models of characters.

Toxic and ordinary texts each get an interpolated Kneser-Ney model of order five over
32 symbols (letters, digits as one, gaps as one, and four classes of all other
characters).  Orders five to three count each class by itself; orders two and one are
shared: what is rare in both classes backs off to one common estimate and so speaks
for neither.  A text is judged by the log-likelihood of both models for each symbol
(the difference, so longer texts weigh no more), over the whole text and over its
most toxic passage of ``PASSAGE`` symbols.  A logistic curve over these two turns
them into a score.

Counts are taken over every labelled text outside the held-out fold, by summing before
the shuffle; no text is shuffled.  The alphabet bounds all tables whatever the corpus
holds: at most 32**4 counts of order four for each class reach the driver, and
workers hold one ratio for each of 32**5 five-grams (64 MB).  The curve is fitted on
at most ``MAX_CALIBRATION`` texts of one fold, judged by models that did not count it.

Defined cases: null text is empty text and is scored like any other; labels with null
id or label are left out, a document with several labels takes their mean, rows that
repeat an id each count with its label; a null id counts as the empty text in the
fold; texts of any length are read whole; equal texts tie in their score; without
labels of both kinds every score is the labels' mean (0 without any label); an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parts import PartLists
from .quality import fold
from .runtime import Stored, materialize, slices, text_buffer
from .warc import file_system

ORDER, SYMBOLS = 5, 32
#: Lower orders that both classes share.
SHARED = 2
#: Symbols of the passage that stands out most.
PASSAGE = 12
THRESHOLD = 0.5
#: Texts that the logistic curve is fitted on at most: those with the smallest hash of their id.
MAX_CALIBRATION = 20_000
#: The fold that the curve is fitted on (0 is held out).
CURVE_FOLD = 1
#: Five-grams that a task gathers before it sums them up.
_GATHERED = 1 << 21
_SLICES = SYMBOLS
_DROPPED = 255

_SYMBOL = np.zeros(256, dtype=np.uint8)
_SYMBOL[65:91] = _SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[48:58] = 27
_SYMBOL[0x80:0xC0] = 28 + (np.arange(0x80, 0xC0) & 3)
_SYMBOL[0xC0:] = _DROPPED  # the following bytes tell such characters apart


def five_grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the five-grams that end at each symbol of each text (with gaps before its start and one at its end), and their number."""
    raw, offsets = text_buffer(column)
    n = len(offsets) - 1
    text = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    symbol = _SYMBOL[raw]
    kept = symbol != _DROPPED
    symbol, text = symbol[kept], text[kept]
    gap = symbol == 0
    kept = np.ones(len(symbol), dtype=bool)
    kept[1:] = ~(gap[1:] & gap[:-1] & (text[1:] == text[:-1]))
    kept[1:] &= ~(gap[1:] & (text[1:] != text[:-1]))
    if len(kept):
        kept[0] = not gap[0]
    symbol, text = symbol[kept], text[kept]
    last = np.searchsorted(text, np.arange(n), "right")
    closed = np.zeros(n, dtype=bool)
    some = last > np.searchsorted(text, np.arange(n), "left")
    closed[some] = symbol[last[some] - 1] == 0
    symbol = np.insert(symbol, last[~closed], 0)
    text = np.insert(text, last[~closed], np.flatnonzero(~closed).astype(np.int32))
    counts = np.bincount(text, minlength=n)
    place = np.arange(len(text), dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts)
    code = symbol.astype(np.int32)
    for back in range(1, ORDER):
        earlier = np.zeros(len(symbol), dtype=np.int32)
        earlier[back:] = symbol[:-back]
        earlier[place < back] = 0
        code += earlier << (5 * back)
    return code, counts


def _classes(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the labelled documents outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic")).where("doc_id is not null and toxic is not null")
    return known.where(fold() != 0).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))


def gram_counts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """toxic (class), curve (whether of the curve's fold), code, n: five-grams of all texts with a class."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    where = read.select("doc_id", F.spark_partition_id().alias("part")).where("doc_id is not null").distinct()
    lists = PartLists(where.join(classes, "doc_id").select("part", "doc_id", (F.col("toxic") * 2 + (fold() == CURVE_FOLD).cast("int")).alias("kind")), "classes")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lists.of(TaskContext.get().partitionId())
        ids, kinds = own.column("doc_id").to_numpy(), own.column("kind").to_numpy()
        order = np.argsort(ids)
        ids, kinds = ids[order], kinds[order]
        met = np.zeros(len(ids), dtype=bool)
        held, size = [], 0
        totals = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
        for whole in batches:
            for part in slices(whole, "text"):
                doc = part.column(0).fill_null(-1).to_numpy()
                at = np.minimum(np.searchsorted(ids, doc), max(len(ids) - 1, 0))
                known = (ids[at] == doc) & part.column(0).is_valid().to_numpy(zero_copy_only=False) if len(ids) else np.zeros(len(doc), dtype=bool)
                if not known.any():
                    continue
                met[at[known]] = True
                codes, counts = five_grams(part.column(1).filter(pa.array(known)))
                held.append(codes + (np.repeat(kinds[at[known]].astype(np.int64), counts) << (5 * ORDER)))
                size += len(codes)
                if size > _GATHERED:
                    totals, held, size = _summed(totals, held), [], 0
        if not met.all():
            raise RuntimeError("the documents were dealt to other partitions when they were read again")
        keys, n = _summed(totals, held)
        kind, code = keys >> (5 * ORDER), keys & (SYMBOLS**ORDER - 1)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(code, pa.int32()), pa.array(n)], ["kind", "code", "n"])

    found = read.mapInArrow(count, "kind int, code int, n long").groupBy("kind", "code").agg(F.sum("n").alias("n"))
    return found.select(F.expr("kind div 2").cast("int").alias("toxic"), (F.col("kind") % 2 == 1).alias("curve"), "code", "n")


def _summed(totals: tuple[np.ndarray, np.ndarray], held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not held:
        return totals
    keys, n = np.unique(np.concatenate(held), return_counts=True)
    both = np.concatenate([totals[0], keys])
    distinct, where = np.unique(both, return_inverse=True)
    return distinct, np.bincount(where, weights=np.concatenate([totals[1], n])).astype(np.int64)


def discount(once: float, twice: float) -> float:
    """Kneser-Ney's absolute discount from the numbers of grams seen once and twice."""
    return once / (once + 2 * twice) if once else 0.5


def interpolated(counts: np.ndarray, off: float, lower: np.ndarray) -> np.ndarray:
    """Probabilities of one order: counts by gram, less the discount, and the lower order for the rest; contexts never seen take the lower order's."""
    table = counts.reshape(-1, SYMBOLS).astype(np.float64)
    base = np.tile(lower.reshape(-1, SYMBOLS), (len(table) // max(1, lower.size // SYMBOLS), 1))
    total, kinds = table.sum(axis=1, keepdims=True), (table > 0).sum(axis=1, keepdims=True)
    seen = total > 0
    total = np.where(seen, total, 1)
    found = np.maximum(table - off, 0) / total + off * kinds / total * base
    return np.where(seen, found, base).ravel()


def lower_orders(fours: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Probabilities of order four of each class from its continuation counts: orders above ``SHARED`` by class, the others of both together."""
    levels = {c: {ORDER - 1: f} for c, f in fours.items()}
    for order in range(ORDER - 2, 0, -1):
        above = {c: levels[c][order + 1] > 0 for c in levels}
        if order == SHARED:
            either = np.any(list(above.values()), axis=0)
            above = dict.fromkeys(levels, either)
        for c in levels:
            levels[c][order] = above[c].reshape(SYMBOLS, -1).sum(axis=0)
    out = {}
    for c, own in levels.items():
        p = np.full(SYMBOLS, 1 / SYMBOLS)
        for order in range(1, ORDER):
            p = interpolated(own[order], discount((own[order] == 1).sum(), (own[order] == 2).sum()), p)
        out[c] = p
    return out


class Ratios:
    """log P(symbol | four before it) of the toxic model less that of the ordinary one, for every five-gram; in the shared folder, a row for each slice."""

    def __init__(self, counts: DataFrame):
        """counts: toxic, code, n."""
        grams = counts.groupBy("toxic", "code").agg(F.sum("n").alias("n"))
        grams = materialize(grams, "grams")
        seen = {r["toxic"]: (r["once"], r["twice"]) for r in grams.groupBy("toxic").agg(F.sum((F.col("n") == 1).cast("long")).alias("once"), F.sum((F.col("n") == 2).cast("long")).alias("twice")).collect()}
        off = {c: discount(*seen.get(c, (0, 0))) for c in (0, 1)}
        low = SYMBOLS ** (ORDER - 1)
        fours = {c: np.zeros(low, dtype=np.int64) for c in (0, 1)}
        found = grams.groupBy("toxic", (F.col("code") % low).alias("code")).agg(F.count(F.lit(1)).alias("n")).toArrow()  # at most 2 * 32**4 rows
        kind, code, n = (found.column(i).to_numpy() for i in range(3))
        for c in fours:
            fours[c][code[kind == c]] = n[kind == c]
        lower = lower_orders(fours)
        shared = grams.sparkSession.sparkContext.broadcast((lower, off))  # two tables of 32**4 probabilities

        def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            below, less = shared.value
            logs = {}
            for c in (0, 1):
                own = frame[frame["toxic"] == c]
                table = np.zeros(low, dtype=np.int64)
                table[own["code"].to_numpy() % low] = own["n"].to_numpy()
                # contexts of this slice begin with its symbol; the lower order leaves that symbol out
                logs[c] = np.log(interpolated(table, less[c], below[c]))
            return pd.DataFrame({"slice": [key[0]], "ratio": [(logs[1] - logs[0]).astype("<f2").tobytes()]})

        every = counts.sparkSession.range(_SLICES).select(F.lit(0).alias("toxic"), (F.col("id") * low).cast("int").alias("code"), F.lit(0).cast("long").alias("n"))
        dealt = grams.unionByName(every).groupBy((F.floor(F.col("code") / low)).cast("int").alias("slice"), "toxic", "code").agg(F.sum("n").alias("n"))
        stored = Stored(dealt.groupBy("slice").applyInPandas(one, "slice int, ratio binary"), "ratios")  # at most 2 * 32**4 rows in a group
        self.path = stored.path

    def table(self) -> np.ndarray:
        """The ratios, read once by each worker."""
        if self.path not in _tables:
            from pyarrow import fs, parquet

            _tables.clear()
            store, base = file_system(self.path)
            low = SYMBOLS ** (ORDER - 1)
            whole = np.zeros(SYMBOLS**ORDER, dtype=np.float16)
            for name in (f.path for f in store.get_file_info(fs.FileSelector(base)) if f.path.endswith(".parquet")):
                with store.open_input_file(name) as source:
                    for batch in parquet.ParquetFile(source).iter_batches(batch_size=1, use_threads=False):  # one slice in memory besides
                        for s, ratio in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                            whole[s * low : (s + 1) * low] = np.frombuffer(ratio.as_buffer(), dtype="<f2")
            pa.default_memory_pool().release_unused()
            _tables[self.path] = whole
        return _tables[self.path]


_tables: dict[str, np.ndarray] = {}


def evidence(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """Two numbers for each text: the mean ratio of its symbols, and that of its most toxic passage."""
    codes, counts = five_grams(column)
    if not len(counts):
        return np.zeros((0, 2))
    sums = np.zeros(len(codes) + 1)
    np.cumsum(table[codes], dtype=np.float64, out=sums[1:])
    ends = np.cumsum(counts)
    starts = ends - counts  # every text has its closing gap, so no count is 0
    mean = (sums[ends] - sums[starts]) / counts
    best = mean.copy()
    if len(codes) >= PASSAGE:
        passage = sums[PASSAGE:] - sums[:-PASSAGE]
        passage = np.append(passage, np.full(PASSAGE - 1, -np.inf)) / PASSAGE
        room = np.repeat(ends, counts) - np.arange(len(codes)) >= PASSAGE
        passage[~room] = -np.inf
        best = np.maximum(best, np.maximum.reduceat(passage, starts))
    return np.column_stack([mean, best])


def fit_curve(rows: np.ndarray, toxic: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (constant first), means and scales of a logistic curve by Newton's method."""
    mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    design = np.column_stack([np.ones(len(rows)), (rows - mean) / scale])
    weight, held = np.zeros(design.shape[1]), np.array([1e-6] + [ridge] * rows.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ weight, -40, 40)))
        slope = p * (1 - p) + 1e-9
        weight = weight + np.linalg.solve((design * slope[:, None]).T @ design + np.diag(held), design.T @ (toxic - p) - held * weight)
    return weight, mean, scale


def _curve_rows(docs: DataFrame, classes: DataFrame, ratios: Ratios, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Evidence and class of at most ``most`` labelled documents."""
    sample = classes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()  # bounded by most
    spark = docs.sparkSession
    # broadcast: at most ``most`` ids
    wanted = F.broadcast(spark.createDataFrame([(r["doc_id"],) for r in sample], "doc_id long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                found = evidence(part.column(1), ratios.table())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found[:, 0]), pa.array(found[:, 1])], ["doc_id", "mean", "best"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(wanted, "doc_id", "left_semi")
    found = own.mapInArrow(run, "doc_id long, mean double, best double").groupBy("doc_id").agg(F.min(F.struct("best", "mean")).alias("e")).orderBy("doc_id").collect()  # at most ``most`` rows
    toxic = {r["doc_id"]: r["toxic"] for r in sample}
    rows = np.array([(r["e"]["mean"], r["e"]["best"]) for r in found], dtype=np.float64).reshape(len(found), 2)
    return rows, np.array([toxic[r["doc_id"]] for r in found], dtype=np.float64)


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, max_calibration: int = MAX_CALIBRATION) -> DataFrame:
    """doc_id, held_out, score, predicted, mean_ratio, passage_ratio - one row per document."""
    classes = materialize(_classes(labels), "labels")
    counts = materialize(gram_counts(docs, classes), "counts")
    kinds = {(r["toxic"], r["curve"]) for r in counts.select("toxic", "curve").distinct().collect()}  # at most four rows
    ratios, curve, share = None, None, 0.0
    if {c for c, _ in kinds} == {0, 1}:
        if all((c, part) in kinds for c in (0, 1) for part in (False, True)):
            rows, toxic = _curve_rows(docs, classes.where(fold() == CURVE_FOLD), Ratios(counts.where("not curve")), max_calibration)
            ratios = Ratios(counts)
        else:  # too few labels to set a fold aside
            ratios = Ratios(counts)
            rows, toxic = _curve_rows(docs, classes, ratios, max_calibration)
        curve = fit_curve(rows, toxic)
    else:
        share = classes.agg(F.avg("toxic")).first()[0] or 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                found, score = np.zeros((part.num_rows, 2)), np.full(part.num_rows, float(share))
                if curve is not None:
                    found = evidence(part.column(1), ratios.table())
                    weight, mean, scale = curve
                    score = 1 / (1 + np.exp(-np.clip(weight[0] + ((found - mean) / scale) @ weight[1:], -700, 700)))
                columns = [part.column(0), part.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(found[:, 0]), pa.array(found[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "mean_ratio", "passage_ratio"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), (fold() == 0).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, mean_ratio double, passage_ratio double")
