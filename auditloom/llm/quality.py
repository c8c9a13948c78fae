"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees on binned features learns one lookup table per
feature, then one per chosen pair; a score is a sum of table entries, added up for
whole batches at once.

Defined cases: null text is empty text and is scored like any other; labels with
null id or quality are left out; a document with several labels takes their mean;
repeated rows are scored each by itself; texts of any length are scored whole; rows
of equal features tie in their score; an empty table gives an empty result; without labels of both kinds every score
is the labels' mean (1 without any label).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import LOWER, NOT_SPACE, Words, slices, text_buffer

#: Labelled rows that a fit uses at most: those with the smallest hash of their id.
MAX_TRAINING_ROWS = 20_000
THRESHOLD = 0.3
FOLDS = 5

FEATURES = (
    "log_words", "distinct_words", "top_word", "word_bytes", "short_words", "one_byte_words", "repeated_pairs",
    "upper", "lower", "digits", "bars", "symbols", "exclaims", "stops", "newlines", "wide",
)
_KINDS = np.full(256, 9, dtype=np.uint8)
_KINDS[65:91] = 0
_KINDS[97:123] = 1
_KINDS[48:58] = 2
_KINDS[124] = 3
_KINDS[[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 92, 94, 95, 96, 126, 91, 93, 123, 125]] = 4
_KINDS[[33, 63]] = 5
_KINDS[[44, 46, 58, 59]] = 6
_KINDS[10] = 7
_KINDS[128:] = 8


def _runs(doc: np.ndarray, values: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the largest number of repeats, per text."""
    distinct, most = np.zeros(n_docs), np.zeros(n_docs)
    if len(values):
        order = np.lexsort((values, doc))
        d, v = doc[order], values[order]
        first = np.ones(len(v), dtype=bool)
        first[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
        at = np.flatnonzero(first)
        lengths = np.diff(np.append(at, len(v)))
        distinct = np.bincount(d[at], minlength=n_docs).astype(np.float64)
        np.maximum.at(most, d[at], lengths)
    return distinct, most


def features(column: pa.Array) -> np.ndarray:
    """The features of each text of a batch; whole texts, no language or source."""
    raw, offsets = text_buffer(column)
    n = len(offsets) - 1
    words = Words(LOWER[raw], offsets, NOT_SPACE)
    count = words.counts.astype(np.float64)
    some = np.maximum(count, 1)
    doc = np.repeat(np.arange(n), words.counts)
    hashed = words.hashes()
    distinct, most = _runs(doc, hashed, n)
    pairs, n_pairs = words.grams(hashed, 2)
    distinct_pairs, _ = _runs(np.repeat(np.arange(n), n_pairs), pairs, n)
    length = words.ends - words.starts
    size = np.diff(offsets)
    kinds = np.bincount(np.repeat(np.arange(n), size) * 10 + _KINDS[raw], minlength=10 * n).reshape(n, 10) if n else np.zeros((0, 10))
    share = kinds / np.maximum(size, 1)[:, None]

    def mean(x: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=x, minlength=n) / some

    left = [np.log1p(count), distinct / some, most / some, mean(length), mean(length <= 3), mean(length == 1), 1 - distinct_pairs / np.maximum(n_pairs, 1)]
    return np.column_stack([*left, *share[:, :9].T]) if n else np.zeros((0, len(FEATURES)))


@dataclass
class Additive:
    """Lookup tables: ``single[j][bin]`` and ``double[(j, k)][bin, bin]``."""

    intercept: float
    edges: list[np.ndarray]
    single: list[np.ndarray]
    coarse: list[np.ndarray]
    double: dict[tuple[int, int], np.ndarray]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of a good label for each row."""
        total = np.full(len(rows), self.intercept)
        for j, table in enumerate(self.single):
            total += table[np.searchsorted(self.edges[j], rows[:, j], "right")]
        codes = {j: np.searchsorted(self.coarse[j], rows[:, j], "right") for pair in self.double for j in pair}
        for (j, k), table in self.double.items():
            total += table[codes[j], codes[k]]
        return 1 / (1 + np.exp(-total))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of bins into two runs."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _shallow(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """A tree of two cuts over one feature's bins: the step of every bin."""
    spans = [(0, len(g))]
    for _ in range(2):
        gain, at, (a, b) = max((*_best_cut(g[a:b], h[a:b], ridge), (a, b)) for a, b in spans)
        if gain <= 1e-9:
            break
        spans.remove((a, b))
        spans += [(a, a + at), (a + at, b)]
    step = np.zeros(len(g))
    for a, b in spans:
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return step


def _shallow_pair(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """A tree that cuts the first feature once and each side on the second once."""
    _, at = _best_cut(g.sum(1), h.sum(1), ridge)
    step, gain = np.zeros_like(g), 0.0
    for rows in (slice(0, at), slice(at, None)):
        side_g, side_h = g[rows].sum(0), h[rows].sum(0)
        _, cut = _best_cut(side_g, side_h, ridge)
        for columns in (slice(0, cut), slice(cut, None)):
            a, b = side_g[columns].sum(), side_h[columns].sum()
            step[rows, columns] = a / (b + ridge)
            gain += a * a / (b + ridge)
    return gain, step


def fit(rows: np.ndarray, labels: np.ndarray, *, bins: int = 32, rounds: int = 150, rate: float = 0.15, pairs: int = 8, pair_bins: int = 8, pair_rounds: int = 60, ridge: float = 5.0) -> Additive:
    """Cyclic boosting: every round gives each table one shallow tree; the pairs of most gain follow."""
    n_features = rows.shape[1]
    share = float(labels.mean()) if len(labels) else 1.0
    start = float(np.log((share + 1e-4) / (1 - share + 1e-4)))
    flat = [np.empty(0)] * n_features
    if share in (0.0, 1.0):
        return Additive(40.0 if share else -40.0, flat, [np.zeros(1)] * n_features, flat, {})
    edges = [_edges(rows[:, j], bins) for j in range(n_features)]
    codes = [np.searchsorted(edges[j], rows[:, j], "right") for j in range(n_features)]
    single = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(labels), start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(n_features):
            g, h = slopes()
            size = len(single[j])
            step = rate * _shallow(np.bincount(codes[j], g, size), np.bincount(codes[j], h, size), ridge)
            single[j] += step
            total += step[codes[j]]
    coarse = [_edges(rows[:, j], pair_bins) for j in range(n_features)]
    rough = [np.searchsorted(coarse[j], rows[:, j], "right") for j in range(n_features)]

    def grid(j: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        shape = (len(coarse[j]) + 1, len(coarse[k]) + 1)
        cell, size = rough[j] * shape[1] + rough[k], shape[0] * shape[1]
        return np.bincount(cell, g, size).reshape(shape), np.bincount(cell, h, size).reshape(shape)

    gains = sorted(((_shallow_pair(*grid(j, k), ridge)[0], j, k) for j in range(n_features) for k in range(j + 1, n_features)), reverse=True)
    double = {(j, k): np.zeros((len(coarse[j]) + 1, len(coarse[k]) + 1)) for _, j, k in gains[:pairs]}
    for _ in range(pair_rounds):
        for (j, k), table in double.items():
            step = rate * _shallow_pair(*grid(j, k), ridge)[1]
            table += step
            total += step[rough[j], rough[k]]
    return Additive(start, edges, single, coarse, double)


# ---------------------------------------------------------------------------


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo the folds; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _feature_rows(docs: DataFrame) -> DataFrame:
    """doc_id, features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                rows = features(part.column(1))
                values = pa.array(rows.ravel())
                offsets = pa.array(np.arange(0, len(values) + 1, len(FEATURES), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "features"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, features array<double>")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Additive:
    """Fit on the labelled documents outside the held-out fold, at most ``max_rows`` of them."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where("doc_id is not null and quality is not null")
    known = known.where(fold() != 0).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect()  # bounded by max_rows
    if not sample:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    wanted = docs.sparkSession.createDataFrame([(r["doc_id"],) for r in sample], "doc_id long")
    # broadcast: at most max_rows ids
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted), "doc_id", "left_semi")
    found = _feature_rows(own).groupBy("doc_id").agg(F.min("features").alias("features")).collect()  # at most max_rows rows
    quality = {r["doc_id"]: r["quality"] for r in sample}
    found.sort(key=lambda r: r["doc_id"])
    rows = np.array([r["features"] for r in found], dtype=np.float64).reshape(len(found), len(FEATURES))
    return fit(rows, np.array([quality[r["doc_id"]] >= 0.5 for r in found], dtype=np.float64))


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted - one row per document."""
    model = train(docs, labels, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                score = model.score(features(part.column(1)))
                columns = [part.column(0), part.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (fold() == 0).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; one pass over the texts besides the fit."""
    model = train(docs, labels, max_rows)

    @F.pandas_udf("boolean")
    def passes(texts: pd.Series) -> pd.Series:
        return _passes(model, texts, threshold)

    return docs.where(passes(F.coalesce(F.col("text"), F.lit(""))))


def _passes(model: Additive, texts: pd.Series, threshold: float) -> pd.Series:
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    parts = [model.score(features(part.column(0))) >= threshold for part in slices(batch, "text")]
    return pd.Series(np.concatenate(parts) if parts else np.zeros(0, dtype=bool))
