"""The pipeline's stages against plain versions on a small table, and the registered queries."""

import importlib.util
import re
import sys

import corpus_pipeline
from auditloom.llm import mixing, quality
from auditloom.llm.queries import oracle_sql, queries

sys.path.insert(0, __file__.rsplit("/", 1)[0])
_spec = importlib.util.spec_from_file_location("operator_tests", __file__.replace("test_pipeline", "test_operators"))
_ops = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_ops)


def test_names():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries())
    assert numbers == list(range(1, 14)) and set(oracle_sql()) <= set(queries())
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline(spark, tmp_path):
    junk = [(2000 + i, "WIN NOW!! " * (20 + i)) for i in range(40)]
    near = [(i, t) for i, t in _ops.near_rows(7)]
    clean = [(3000 + i, _ops.words(60 + i, 100 + i)) for i in range(60)]
    rows = [*near, *clean, *[(i + 5000, t) for i, t in clean[:20]], *junk]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 0) for i, _ in junk] + [(i, 1) for i, _ in near + clean]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, before, str(tmp_path))
        assert after.columns == docs.columns, name
        after.write.parquet(str(tmp_path / name.replace(" ", "_")))
        after = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        old, new = {r["doc_id"]: r["text"] for r in before.collect()}, [r["doc_id"] for r in after.collect()]
        if name.startswith("quality"):
            passed = {r["doc_id"] for r in quality.classify(before, spark.read.parquet(str(tmp_path / "labels.parquet"))).where("predicted = 1").collect()}
            assert set(new) == passed and {i for i, _ in clean} <= passed and not {i for i, _ in junk} & passed
        elif name.startswith("exact"):
            assert sorted(new) == sorted({t: i for i, t in sorted(old.items())}.values())
        elif name.startswith("minhash"):
            assert set(new) == {i for i, _, c in _ops.plain_components(list(old.items()), corpus_pipeline.NEAR_PERCENT) if i == c}
        else:
            taken = sum(r["taken"] for r in mixing.source_mixing(before).collect())
            assert sum(len(r["text"].split()) for r in after.collect()) == taken
        before = after
    packed = corpus_pipeline.STAGES[4][1](spark, before, str(tmp_path))
    assert packed.where("start = 0").count() == before.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Null ids, texts and sources, repeated ids, blank and long texts, and columns named like the operators' own."""
    clean = [(100 + i, _ops.words(60 + i, 500 + i)) for i in range(30)]
    junk = [(400 + i, "WIN NOW!! " * (20 + i)) for i in range(30)]
    odd = [(None, _ops.words(70, 900)), (None, _ops.words(70, 901)), (None, None), (600, None), (601, ""), (602, " \t "), (603, "x" * 50_000), (604, _ops.words(20_000, 902))]
    repeated = [(100, _ops.words(80, 903)), (100, clean[0][1])]
    rows = [(i, t, "en", None if n % 3 == 0 else f"s{n % 3}", len(t or ""), n, "k", "r", n) for n, (i, t) in enumerate([*clean, *junk, *odd, *repeated])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, root string, size int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 0) for i, _ in junk] + [(i, 1) for i, _ in clean] + [(None, 1), (601, None)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, before, str(tmp_path)).write.parquet(str(tmp_path / name.replace(" ", "_")))
        after = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        assert after.columns == docs.columns, name
        old, new = [r["text"] or "" for r in before.collect()], [r["text"] or "" for r in after.collect()]
        if name.startswith("mixing"):
            assert sum(len(t.split()) for t in new) == sum(r["taken"] for r in mixing.source_mixing(before).collect())
        else:
            assert {t for _, t in clean} <= set(new) <= set(old) and not {t for _, t in junk} & set(new), name
        if name.startswith("exact"):
            assert sorted(new) == sorted(set(old))
        if name.startswith("minhash"):
            assert sorted(new) == sorted(old)  # no near copies among these
        before = after
    assert corpus_pipeline.STAGES[4][1](spark, before, str(tmp_path)).where("start = 0").count() == before.count()


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
