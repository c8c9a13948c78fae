"""The toxicity models against plain ones, and their scores on texts with planted words."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditloom.llm import toxicity
from auditloom.llm.parts import PartLists

DOCS = "doc_id long, text string, toxic string, score string, part string, code string, kind string"


def docs(spark, rows, parts=3):
    return spark.createDataFrame(spark.sparkContext.parallelize([(i, t, "t", "s", "p", "c", "k") for i, t in rows], parts), DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int").withColumn("text", F.lit("clash"))


def symbols(text):
    out = []
    for b in (text or "").encode():
        c = chr(b).lower()
        s = ord(c) - 96 if "a" <= c <= "z" else 27 if "0" <= c <= "9" else 28 + (b & 3) if 0x80 <= b < 0xC0 else None if b >= 0xC0 else 0
        if s is not None and not (s == 0 and (not out or out[-1] == 0)):
            out.append(s)
    return out if out and out[-1] == 0 else [*out, 0]


def grams(text):
    padded = [0] * 4 + symbols(text)
    return [tuple(padded[i : i + 5]) for i in range(len(padded) - 4)]


def code(gram):
    return sum(s << (5 * (4 - i)) for i, s in enumerate(gram))


TEXTS = ["You are a  fool!", "", None, "x", "  ..  ", "Été 日本語 – naïve", "ends. ", "a1b22", "é", "A" * 50, "q\n\nr", "", "!!"]


def test_five_grams_equal_plain_ones():
    codes, counts = toxicity.five_grams(pa.array(TEXTS, pa.string()))
    want = [[code(g) for g in grams(t)] for t in TEXTS]
    assert counts.tolist() == [len(w) for w in want] and codes.tolist() == [c for w in want for c in w]
    assert all(len(x) == 0 for x in toxicity.five_grams(pa.array([], pa.string())))


class Plain:
    """An interpolated Kneser-Ney model of one class, with dictionaries."""

    def __init__(self, by_class, own):
        counts = {c: Counter(g for t in texts for g in grams(t)) for c, texts in by_class.items()}
        levels = {5: counts[own]}
        level = {c: set(x) for c, x in counts.items()}
        for order in (4, 3, 2, 1):
            if order == 2:
                level = {c: level[0] | level[1] for c in level}
            levels[order] = Counter(g[1:] for g in level[own])
            level = {c: {g[1:] for g in level[c]} for c in level}
        self.levels, self.off, self.total, self.kinds = levels, {}, {}, {}
        for order, found in levels.items():
            once, twice = (sum(n == k for n in found.values()) for k in (1, 2))
            self.off[order] = once / (once + 2 * twice) if once else 0.5
            self.total[order], self.kinds[order] = defaultdict(int), defaultdict(int)
            for g, n in found.items():
                self.total[order][g[:-1]] += n
                self.kinds[order][g[:-1]] += 1

    def p(self, gram):
        if not gram:
            return 1 / 32
        order, below = len(gram), self.p(gram[1:]) if len(gram) > 1 else 1 / 32
        total = self.total[order][gram[:-1]]
        if not total:
            return below
        return max(self.levels[order][gram] - self.off[order], 0) / total + self.off[order] * self.kinds[order][gram[:-1]] / total * below


WORDS = ["river", "stone", "walk", "light", "often", "green", "hand", "paper", "seven", "north", "Öl", "über"]
BAD = ["scoundrel", "nitwit", "vermin"]


def corpus(n, seed=0, bad=0.25):
    rng, rows, marks = random.Random(seed), [], []
    for i in range(n):
        words, toxic = [rng.choice(WORDS) for _ in range(rng.randrange(3, 120))], rng.random() < bad
        if toxic:
            for _ in range(1 + len(words) // 30):
                words.insert(rng.randrange(len(words) + 1), rng.choice(BAD))
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    return rows, marks


def test_ratios_equal_plain_models(spark):
    rows, marks = corpus(120)
    marks += [(3, None), (None, 1)]
    counts = toxicity.gram_counts(docs(spark, [*rows, (None, "no id")]), toxicity._classes(labels(spark, marks)))
    ratios = toxicity.Ratios(counts).table()
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    by_class = {c: [t for (i, t), (_, m) in zip(rows, marks) if m == c and i not in held] for c in (0, 1)}
    models = [Plain(by_class, c) for c in (0, 1)]
    rng = random.Random(1)
    tried = [g for t in by_class[0][:5] + by_class[1][:5] for g in grams(t)[:60]] + [tuple(rng.randrange(32) for _ in range(5)) for _ in range(300)]
    for g in tried:
        want = math.log(models[1].p(g)) - math.log(models[0].p(g))
        assert float(ratios[code(g)]) == pytest.approx(want, abs=0.01), g


def test_evidence_equals_plain_sums():
    table = np.random.default_rng(3).normal(size=32**5).astype(np.float16)
    texts = [*TEXTS, "some longer text of words, twice. " * 8]
    got = toxicity.evidence(pa.array(texts, pa.string()), table)
    for text, (mean, best) in zip(texts, got):
        own = [float(table[code(g)]) for g in grams(text)]
        runs = [sum(own[i : i + 12]) / 12 for i in range(len(own) - 11)]
        assert mean == pytest.approx(sum(own) / len(own)) and best == pytest.approx(max([mean, *runs][:1] + runs))


def test_planted_words_are_found_and_clean_texts_left_alone(spark):
    rows, marks = corpus(900, 5)
    odd = [(None, "river stone"), (2000, None), (2001, ""), (2002, " ".join(WORDS * 20_000)), (2003, " ".join([*WORDS * 300, "nitwit", "scoundrel", *WORDS * 300])), (5, rows[5][1])]
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs(spark, rows + odd), labels(spark, marks)).collect()}
    assert len(out) == len(rows) + len(odd) - 1
    wrong = [i for i, m in marks if out[i]["predicted"] != m]
    assert len(wrong) <= 9 and sum(out[i]["held_out"] for i, _ in marks) > 100
    assert len([i for i in wrong if out[i]["held_out"]]) <= 3
    assert [out[i]["predicted"] for i in (None, 2000, 2001, 2002, 2003)] == [0, 0, 0, 0, 1]
    assert all(r["held_out"] == (zlib.crc32(str("" if i is None else i).encode()) % 5 == 0) for i, r in out.items())


def test_labels_of_one_kind_and_empty_tables(spark):
    one = toxicity.toxicity(docs(spark, [(1, "a"), (2, "b"), (3, None)]), labels(spark, [(1, 1), (2, 1), (3, 1)])).collect()
    assert {r["score"] for r in one} == {1.0} and {r["predicted"] for r in one} == {1}
    none = toxicity.toxicity(docs(spark, [(1, "a"), (2, "b")]), labels(spark, [])).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.toxicity(docs(spark, []), labels(spark, [(1, 1), (2, 0)])).collect() == []


def test_few_labels(spark):
    rows, marks = corpus(12, 2, 0.5)
    got = toxicity.toxicity(docs(spark, rows), labels(spark, marks)).collect()
    assert len(got) == 12 and all(0 <= r["score"] <= 1 for r in got)


def test_part_lists(spark):
    rows = spark.range(0, 5000, 1, 70).select("id", F.spark_partition_id().alias("part"))
    lists = PartLists(rows, "lists")
    assert lists.of(33).column("id").to_pylist() == [r["id"] for r in rows.where("part = 33").orderBy("id").collect()]
    assert lists.of(5000).num_rows == 0
