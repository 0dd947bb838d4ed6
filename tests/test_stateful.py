"""Stateful streams against the batch forms, on the same events in shuffled files."""

import random

import pytest
from pyspark.sql import functions as F

from tidepool.streaming import detectors, stateful

FAR = 10**9
SCHEMA = "key long, ts timestamp, seq long, ok boolean, offset long"


@pytest.fixture(scope="module")
def events():
    """Times rise from file to file but for a disorder well within the delay; a hot key; equal times."""
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4]), 1000 * k // 3 + rng.randrange(20) * 1000, k, rng.random() < 0.05, rng.randrange(100)) for k in range(900)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def folder(spark, events, tmp_path_factory):
    """Six files by time, each shuffled and overlapping its neighbours, then one far later event that lets the watermark pass all."""
    path = str(tmp_path_factory.mktemp("events"))
    rng = random.Random(4)
    by_file = {}
    for row in events:
        by_file.setdefault(min(5, max(0, int(row[1] / 55_000 + rng.random() * 0.4))), []).append(row)
    for k in sorted(by_file):
        frame = spark.createDataFrame(by_file[k], "key long, t long, seq long, ok boolean, offset long")
        frame.select("key", F.timestamp_millis("t").alias("ts"), "seq", "ok", "offset").coalesce(1).write.mode("append").parquet(path)
    for late in (FAR, 3 * FAR):
        frame = spark.createDataFrame([(99, late, -late, True, 0)], "key long, t long, seq long, ok boolean, offset long")
        frame.select("key", F.timestamp_millis("t").alias("ts"), "seq", "ok", "offset").coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture(scope="module")
def run(spark, folder, tmp_path_factory):
    stateful.use_rocksdb(spark)

    def go(made, name):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        writer = made(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
        query = writer.option("checkpointLocation", str(tmp_path_factory.mktemp(name))).start()
        query.awaitTermination()
        progress = query.lastProgress
        return spark.table(name).where("key <> 99").collect(), progress

    yield go
    spark.conf.unset(stateful.PROVIDER)


def batch(spark, events):
    return spark.createDataFrame(events, "key long, ms long, seq long, ok boolean, offset long")


def test_rates(spark, run, events):
    got, progress = run(lambda s: stateful.search_rates(s, "key", "seq", 10_000, "60 seconds"), "rates")
    want = detectors.anchored_counts(batch(spark, events).withColumnRenamed("seq", "event_id"), "key", 10_000).collect()
    assert {(r.key, r.ms, r.seq, r.n) for r in got} == {(r.key, r.ms, r.event_id, r.n) for r in want} and len(got) == len(events)
    # what the far later event left is all that is remembered
    assert sum(s.numRowsTotal for s in progress.stateOperators) <= 6


def test_failures(spark, run, events):
    got, _ = run(lambda s: stateful.limited_attempts(s, "key", "seq", delay="60 seconds"), "failures")
    want = detectors.failure_runs(batch(spark, events).withColumnRenamed("key", "ip")).collect()
    assert {(r.key, r.seq, r.limited) for r in got} == {(r.ip, r.seq, r.limited) for r in want} and len(got) == len(events)
    assert any(r.limited for r in got)


def test_runs(spark, run, events):
    got, _ = run(lambda s: stateful.page_runs(s, "key", "seq", delay="60 seconds"), "pages")
    rows = batch(spark, events).withColumn("place", F.struct("ms", "seq"))
    want = detectors.increasing_runs(rows, "key", "place").collect()
    assert {(r.key, r.seq, r.run, r.flagged) for r in got} == {(r.key, r.seq, r.run, r.flagged) for r in want} and len(got) == len(events)
