"""License scan by diagonal voting.

All rolling word k-grams of every text are joined to the positions of the same
k-grams in license templates.  A match votes for its diagonal (position in the text
minus position in the template); votes are summed by diagonal, neighbouring
diagonals are merged (words put in or left out shift the diagonal), and each merged
span is verified: every vote by a second, independent hash of its words, and the
span by the share of the template's k-grams that it covers.

Short phrases vote with two words and count only if every k-gram stands on one
diagonal; whole license notices vote with five words and count from half on.

Defined cases: null and empty texts have no words and no labels; repeated rows are
scanned each by itself; overlapping places are all counted; texts of any length are
scanned whole; of labels and places that tie all are kept (labels sorted); an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import ALNUM, LOWER, Words, list_column, materialize, slices, text_buffer

PHRASE_GRAM, NOTICE_GRAM = 2, 5
#: Share of a notice's k-grams that a span must cover.
LEAST_COVER = 0.5
#: Diagonals of one span lie no further apart, in words.
MOST_SHIFT = 4


@dataclass(frozen=True)
class Template:
    """A license text: ``base`` ones are the phrases whose places are counted."""

    label: str
    text: str
    base: bool = False
    notice: bool = False


# Phrases and notices of public licenses (fixed values).
TEMPLATES = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
    Template("lgpl", "lesser general public license"),
    Template("agpl", "affero general public license"),
    Template("mpl", "mozilla public license"),
    Template("bsd", "bsd license"),
    Template("epl", "eclipse public license"),
    Template("isc", "isc license"),
    Template("cc-by", "cc by"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("creative-commons", "creative commons attribution"),
    Template("public-domain", "released into the public domain"),
    Template("all-rights-reserved", "all rights reserved"),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", notice=True),
    Template("apache-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", notice=True),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version", notice=True),
    Template("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", notice=True),
    Template("isc-notice", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", notice=True),
    Template("cc-notice", "this work is licensed under a creative commons attribution", notice=True),
    Template("warranty-notice", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", notice=True),
)
#: The gram that every text has once, so that texts without a match stay in the result.
_PRESENT = np.uint64(0x0123456789ABCDEF)


def _grams(column: pa.Array, k: int) -> tuple[Words, list[np.ndarray], np.ndarray]:
    raw, offsets = text_buffer(column)
    words = Words(LOWER[raw], offsets, ALNUM)
    both = [words.grams(words.hashes(w), k, w) for w in (0, 1)]
    return words, [g for g, _ in both], both[0][1]


def template_grams(templates: tuple[Template, ...]) -> list[tuple[int, int, int, int, int]]:
    """(gram, check, template, position, grams of the template) of all templates, and the gram of presence (template -1)."""
    rows = [(int(_PRESENT.view(np.int64)), 0, -1, 0, 1)]
    for t, template in enumerate(templates):
        _, (first, second), _ = _grams(pa.array([template.text]), NOTICE_GRAM if template.notice else PHRASE_GRAM)
        for p, (g, c) in enumerate(zip(first.view(np.int64).tolist(), second.view(np.int64).tolist(), strict=True)):
            rows.append((g, c, t, p, len(first)))
    return rows


def document_grams(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, n_words, grams, checks, n_first: two- and five-word grams (the first ``n_first`` are two-word ones) after the gram of presence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                words, short, n_short = _grams(part.column(2), PHRASE_GRAM)
                _, long, n_long = _grams(part.column(2), NOTICE_GRAM)
                n = n_short + n_long + 1
                at = np.cumsum(n) - n
                from_short = np.repeat(at + 1 - (np.cumsum(n_short) - n_short), n_short) + np.arange(len(short[0]))
                from_long = np.repeat(at + 1 + n_short - (np.cumsum(n_long) - n_long), n_long) + np.arange(len(long[0]))
                lists = []
                for a, b, present in zip(short, long, (_PRESENT, np.uint64(0)), strict=True):
                    flat = np.empty(int(n.sum()), dtype=np.uint64)
                    flat[at], flat[from_short], flat[from_long] = present, a, b
                    lists.append(list_column(flat, n))
                columns = [part.column(0), part.column(1), pa.array(words.counts, pa.int64()), *lists, pa.array(n_short, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "n_words", "grams", "checks", "n_first"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, row_key long, n_words long, grams array<long>, checks array<long>, n_first int")


def votes(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, row_key, n_words, template, diagonal, n, size: verified votes by offset diagonal (template -1: the text itself, n: how often its row occurs)."""
    spark: SparkSession = docs.sparkSession
    table = spark.createDataFrame(template_grams(templates), "gram long, check long, template int, position int, size int")
    each = document_grams(docs).select("doc_id", "row_key", "n_words", "checks", "n_first", F.posexplode("grams").alias("i", "gram"))
    # broadcast: a few hundred rows, fixed by the templates
    met = each.join(F.broadcast(table), "gram").where(F.get("checks", F.col("i")) == F.col("check"))
    in_text = F.when(F.col("i") <= F.col("n_first"), F.col("i") - 1).otherwise(F.col("i") - 1 - F.col("n_first"))
    diagonal = F.when(F.col("template") < 0, F.lit(0)).otherwise(in_text - F.col("position"))
    return met.groupBy("doc_id", "row_key", "n_words", "template", diagonal.alias("diagonal"), "size").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"), F.max("position").alias("last"))


def spans(found: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, row_key, template, start, cover: neighbouring diagonals merged and verified."""
    notice = F.col("template").isin([i for i, t in enumerate(templates) if t.notice])
    text = Window.partitionBy("doc_id", "row_key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(text) > MOST_SHIFT, F.lit(True)) | ~notice
    cut = found.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(text))
    merged = cut.groupBy("doc_id", "row_key", "template", "run").agg(F.sum("n").alias("n"), F.min(F.col("diagonal") + F.col("first")).alias("start"), F.max("size").alias("size"))
    cover = F.least(F.lit(1.0), F.col("n") / F.col("size"))
    return merged.withColumn("cover", cover).where(F.when(notice, cover >= LEAST_COVER).otherwise(F.col("n") == F.col("size")))


def license_scan(docs: DataFrame, *, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score - one row per input row.

    score is the largest cover of a span: 1 for a whole phrase or notice, else 0.5
    or more for a notice in part, 0 without any.
    """
    found = materialize(votes(docs, templates), "votes")
    base = [i for i, t in enumerate(templates) if t.base]
    label = F.element_at(F.array(*[F.lit(t.label) for t in templates]), F.col("template") + 1)
    # rows that repeat id and text vote together: their number divides the votes
    rows = found.withColumn("repeats", F.max(F.when(F.col("template") < 0, F.col("n"))).over(Window.partitionBy("doc_id", "row_key")))
    texts = rows.where("template < 0").select("doc_id", "row_key", "n_words", "repeats")
    hits = spans(rows.where("template >= 0").withColumn("n", F.col("n") / F.col("repeats")), templates)
    of_base = F.col("template").isin(base)
    per_text = hits.withColumn("label", label).groupBy("doc_id", "row_key").agg(
        F.count_if(of_base).alias("n_base"),
        F.min(F.when(of_base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(of_base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(of_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
    )
    per_text = per_text.select(F.col("doc_id").alias("d"), F.col("row_key").alias("k"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    out = texts.join(per_text, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("k")), "left")
    out = out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("repeats").cast("int"))))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"),
    )
