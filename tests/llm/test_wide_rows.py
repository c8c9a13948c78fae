"""Rows that hold many vectors reach the Python workers of op10 a few at a time."""

import numpy as np
import pyarrow as pa
import pytest

from auditloom.llm import ann

KEYS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


def _most_at_once(spark) -> int:
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return max(r["n"] for r in spark.range(0, 3000, 1, 1).mapInArrow(sizes, "n long").collect())


def test_descent_and_walk_take_few_rows_at_once(spark, monkeypatch):
    seen = []
    for name in ("_descend", "_expand", "_advance"):

        def probe(*given, inner=getattr(ann, name), name=name):
            if name not in [n for n, _ in seen]:
                seen.append((name, max(_most_at_once(spark), int(spark.conf.get(KEYS[1])))))
            return inner(*given)

        monkeypatch.setattr(ann, name, probe)
    before = [spark.conf.get(k) for k in KEYS]
    x = np.random.default_rng(5).standard_normal((300, 8))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert ann.nearest_neighbours(table, beam=64).count() == 30
    assert {n for n, _ in seen} == {"_descend", "_expand", "_advance"} and max(n for _, n in seen) <= 256
    assert [spark.conf.get(k) for k in KEYS] == before
    with pytest.raises(ZeroDivisionError), ann.wide_rows(spark):
        raise ZeroDivisionError
    assert [spark.conf.get(k) for k in KEYS] == before


def test_codes_are_read_where_they_lie():
    x = np.random.default_rng(6).standard_normal((7, 5)).astype("<f4")
    rows = pa.array([r.tobytes() for r in x], pa.binary())
    lists = pa.ListArray.from_arrays(pa.array([0, 2, 2, 7], pa.int32()), rows)
    assert (ann._codes(rows) == x).all() and (ann._codes(rows.slice(2, 3)) == x[2:5]).all()
    assert (ann._codes(rows.cast(pa.large_binary()).slice(1)) == x[1:]).all()
    assert (ann._codes(lists.slice(1).flatten()) == x[2:]).all() and len(ann._codes(rows[:0])) == 0
    row, values = ann._flat(pa.array([[1, 2], None, [], [3]], pa.list_(pa.int64())))
    assert row.tolist() == [0, 0, 3] and values.to_pylist() == [1, 2, 3]
