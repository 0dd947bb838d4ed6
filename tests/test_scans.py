"""Segmented scans against plain loops, and how a hot key is dealt out."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidepool.operators import scans, temporal
from tidepool.streaming import detectors


def events(seed, n=600):
    """A key with a third of the rows and more, equal times, and a null key."""
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 2, 3, None, *range(4, 9)]), k, rng.choice([rng.randrange(400), rng.randrange(40_000)])) for k in range(n)]


def by_key(rows):
    out = {}
    for key, k, ms in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1])):
        out.setdefault(key, []).append((ms, k))
    return out


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, "user_id long, event_id long, ms long")


@pytest.fixture(params=["plain", "some crowded", "16 slices"])
def slices(request, monkeypatch):
    """No key crowded, the hot key crowded, and all of them, each in many slices."""
    monkeypatch.setattr(scans, "slice_count", lambda rows: 16)
    monkeypatch.setattr(scans, "CROWD", {"plain": 1 << 20, "some crowded": 100, "16 slices": 0}[request.param])


def test_positions_and_last_values(frame, monkeypatch):
    monkeypatch.setattr(scans, "slice_count", lambda rows: 16)
    rows = events(1)
    seq = scans.ordered(frame(rows), "user_id", ["ms", "event_id"])
    got = scans.carried(seq, "user_id", F.when(F.col("event_id") % 7 == 0, F.col("event_id")), "last")
    got = scans.previous(got, "user_id", ["event_id"]).orderBy("_at").collect()
    assert [r._at for r in got] == list(range(len(rows)))
    want = []
    for own in by_key(rows).values():
        last = before = None
        for _, k in own:
            last = k if k % 7 == 0 else last
            want.append((k, last, before))
            before = k
    assert [(r.event_id, r.last, r._previous and r._previous.event_id) for r in got] == want


@pytest.mark.parametrize("size", [10, 300, 5000])
def test_anchored_windows(frame, slices, size):
    rows = events(size)
    want = set()
    for key, own in by_key(rows).items():
        counts, _, _ = detectors.anchored_state([ms for ms, _ in own], size)
        want |= {(key, k, ms, n) for (ms, k), n in zip(own, counts)}
    got = detectors.anchored_counts(frame(rows), size_ms=size).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(rows)


def test_failures(spark, slices):
    rng = random.Random(4)
    rows = [(rng.choice("aaab"), k, rng.randrange(3_000_000), rng.random() < 0.03) for k in range(900)]
    got = detectors.failure_runs(spark.createDataFrame(rows, "ip string, seq long, ms long, ok boolean")).collect()
    state, want = {}, set()
    for ip, k, ms, ok in sorted(rows, key=lambda r: (r[2], r[1])):
        start, n = state.get(ip, (None, 0))
        if ok:
            start, n = None, 0
        else:
            _, start, n = detectors.anchored_state([ms], detectors.WINDOW_MS, start, n)
        state[ip] = start, n
        want.add((ip, k, n >= 10))
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    assert any(limited for _, _, limited in want)


def test_runs_and_sessions(spark, frame, slices):
    rows = events(5)
    got = detectors.sessions(frame(rows), gap_ms=25).collect()
    want = []
    for key, own in by_key(rows).items():
        for ms, _ in own:
            if want and want[-1][0] == key and ms - want[-1][2] < 25 and want[-1][3]:
                want[-1][2:] = [ms, want[-1][3] + 1]
            else:
                want.append([key, ms, ms, 1])
    assert sorted(map(tuple, want), key=repr) == sorted(map(tuple, got), key=repr)
    pages = [(key, k, ms) for key, own in by_key(rows).items() for k, (ms, _) in enumerate(sorted(own, key=lambda x: x[1]))]
    got = detectors.increasing_runs(spark.createDataFrame(pages, "session_id long, seq long, offset long")).collect()
    assert len(got) == len(pages)
    run = before = None
    for key, k, offset in pages:
        run = run + 1 if k and offset > before else 1
        before = offset
        assert (key, k, offset, run, run >= 5) in {tuple(r) for r in got if r.session_id == key and r.seq == k}


def test_as_of(spark, slices):
    rng = random.Random(6)
    versions = [(rng.choice([1, 1, 2, None]), t, f"v{t}") for t in rng.sample(range(1000), 200)]
    probes = [(rng.choice([1, 1, 1, 2, 3]), rng.choice([None, rng.randrange(1000)]), k) for k in range(400)]
    got = temporal.as_of(spark.createDataFrame(probes, "id long, at long, k long"), spark.createDataFrame(versions, "id long, valid_from long, value string")).collect()
    want = set()
    for i, at, k in probes:
        best = max((v for v in versions if v[0] == i and at is not None and v[1] <= at), key=lambda v: v[1], default=(None, None, None))
        want.add((i, at, k, *best[1:]))
    assert {tuple(r) for r in got} == want and len(got) == len(probes)


def test_a_hot_key_is_spread(spark, monkeypatch):
    monkeypatch.setattr(scans, "slice_count", lambda rows: 32)
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("user_id"), F.col("id").alias("event_id"), (F.col("id") * 7919 % 1_000_003).alias("ms"))
    seq = scans.ordered(rows, "user_id", ["ms", "event_id"])
    sizes = [r["count"] for r in seq.where("user_id = 0").groupBy("_slice").count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 5000
    plan = scans.carried(seq, "user_id", F.col("ms"), "x")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    windows = [line for line in text.splitlines() if "hashpartitioning(" in line]
    assert windows and all("_slice" in line for line in windows)


@pytest.mark.parametrize("size", [0, 7, 1000])
def test_counts_go_on_over_batches(size):
    """Any cut of the rows into batches gives the counts of a loop."""
    rng = random.Random(size)
    rows = sorted((rng.choice("ab"), rng.randrange(300), k, rng.random() < 0.05) for k in range(200))
    table = pa.table({"key": [r[0] for r in rows], "id": [r[2] for r in rows], "ms": [r[1] for r in rows], "reset": [r[3] for r in rows]})
    want, held = [], {}
    for key, ms, _, reset in rows:
        (n,), start, count = ([0], None, 0) if reset else detectors.anchored_state([ms], size, *held.get(key, (None, 0)))
        held[key] = (start, count)
        want.append(n)
    for _ in range(20):
        cuts = sorted(rng.sample(range(200), rng.randrange(6)))
        batches = [b for low, high in zip([0, *cuts], [*cuts, 200]) for b in table.slice(low, high - low).combine_chunks().to_batches()]
        got = [n for b in scans.counting(size, True)(iter(batches)) for n in b.column(3).to_pylist()]
        assert got == want
