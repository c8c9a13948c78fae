"""The stateful login throttle against the batch form, over files that arrive one by one, out of order, with a restart."""

import random

import pytest
from pyspark.sql import functions as F

from auditloom.operators import attempts
from auditloom.streaming import throttle

SCHEMA = "key string, ts timestamp, failed boolean"
START = 1_700_000_000


@pytest.fixture
def rocks(spark):
    for k, v in throttle.STATE_STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k in throttle.STATE_STORE:
        spark.conf.unset(k)


def arrive(spark, folder, rows, n):
    made = spark.createDataFrame([(k, float(START + at), f) for k, at, f in rows], "key string, at double, failed boolean")
    made.select("key", F.col("at").cast("timestamp").alias("ts"), "failed").coalesce(1).write.mode("append").parquet(f"{folder}/{n:03d}")


def run(spark, folder, out, checkpoint, **parameters):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    query = throttle.login_failures(stream, **parameters).writeStream.format("parquet").option("checkpointLocation", checkpoint).start(out)
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def batch(spark, rows, **parameters):
    made = spark.createDataFrame([(k, START + int(at), f) for k, at, f in rows], "key string, at long, failed boolean")
    found = attempts.login_failures(made, **parameters).groupBy("key", "at").agg(F.count("*").alias("attempts"), F.max("failures").alias("failures"), F.max("locked").alias("locked"))
    return sorted(map(tuple, found.collect()))


def test_stream_equals_batch(rocks, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), rng.randrange(0, 4000) + rng.choice([0, 0.25, 0.9995]), rng.random() < 0.8) for _ in range(250)]
    rows += [("hot", 1000 + i % 3, True) for i in range(300)] + [("hot", 1002, False), ("hot", 1003, True), ("hot", 1500, False), ("hot", 1501, True), ("edge", 10, True), ("edge", 910, True), ("edge", 1811, True)]
    rows.sort(key=lambda r: r[1] + rng.randrange(0, 200))  # out of order, but never later than allowed
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    parts = [rows[k : k + 120] for k in range(0, len(rows), 120)]
    for n, part in enumerate(parts[:3]):
        arrive(rocks, folder, part, n)
    run(rocks, folder, out, checkpoint)
    first = rocks.read.parquet(out).count()
    for n, part in enumerate(parts[3:], 3):
        arrive(rocks, folder, part, n)
    arrive(rocks, folder, [("clock", 9000, False)], 90)
    arrive(rocks, folder, [("a", 100, True), ("clock", 9001, False)], 91)  # far too late: dropped
    run(rocks, folder, out, checkpoint)  # goes on from the checkpoint
    got = sorted(tuple(r) for r in rocks.read.parquet(out).where("key <> 'clock'").collect())
    assert 0 < first < len(got)
    assert got == batch(rocks, rows)
    assert {r[4] for r in got if r[0] == "hot"} == {True, False}


def test_stream_windows_end_on_both_sides(rocks, tmp_path):
    rows = [("k", 0, True), ("k", 10, True), ("k", 11, True), ("k", 21, None), ("k", 22, True)]
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    arrive(rocks, folder, [*rows, ("z", 5000, False)], 0)
    run(rocks, folder, out, checkpoint, seconds=10, most=2)
    got = [tuple(r)[1:] for r in rocks.read.parquet(out).where("key = 'k'").orderBy("at").collect()]
    assert [(at - START, n, locked) for at, _, n, locked in got] == [(0, 1, False), (10, 2, True), (11, 2, True), (21, 0, False), (22, 1, False)]
