"""Product codes against Lloyd's method in plain Python integers, and what a round moves."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tidepool.llm import codebooks

SCHEMA = "vec_id long, embedding array<double>, label int, VEC_ID string, block int, `a.b` int"


def slow(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    dims = len(kept[0][1])
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v], label) for i, v, label in kept if len(v) == dims]
    bounds = [dims * p // parts for p in range(parts + 1)]
    cut = [[v[bounds[p] : bounds[p + 1]] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        chosen = [[near(p, c[p])[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, chosen) if a[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    final = [[near(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in final]
    by_label = {}
    for (_, _, label), error in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + error
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    most = (1 << 63) - 1
    rows = [(i, "".join(f"{k:02x}" for _, k in f), min(error, most), min(by_label[label], most), sha) for (i, _, label), f, error in zip(kept, final, errors)]
    return sorted(rows, key=repr)


def fast(spark, rows, **more):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in codebooks.product_codes(frame, **more).collect()), key=repr)


def test_against_plain_integers(spark, monkeypatch):
    monkeypatch.setattr(codebooks, "BLOCK", 37)
    rng = random.Random(13)
    rows = [(rng.randrange(10**6), [round(rng.gauss(0, 0.3), rng.choice([1, 5])) for _ in range(64)], rng.choice([None, 0, 1, 1, 1])) for _ in range(300)]
    rows += [(3, None, 1), (4, [0.1] * 63 + [None], 1), (5, [float("nan")] * 64, 1), (6, [float("inf")] + [0.0] * 63, 0), (None, [0.5] * 64, 2), rows[0], rows[0], (10**7, [0.5] * 3, 0)]
    assert fast(spark, rows) == slow(rows)


@pytest.mark.parametrize("dims", [0, 3, 8, 13])
def test_few_rows_and_odd_lengths(spark, dims):
    rng = random.Random(dims)
    rows = [(k, [rng.random() for _ in range(dims)], k % 2) for k in range(9)]
    assert fast(spark, rows) == slow(rows)


def test_huge_components(spark):
    rng = random.Random(5)
    rows = [(k, [rng.choice([1e300, -1e300, 3e12, -7.25, 1e-320, 2.0**40 + 0.3, -1e18]) * rng.random() for _ in range(16)], None) for k in range(40)]
    assert fast(spark, rows, entries=5) == slow(rows, entries=5)
    rows = [(k, [float(rng.randrange(-(2**33), 2**33)) for _ in range(16)], 1) for k in range(60)]
    assert fast(spark, rows, entries=4) == slow(rows, entries=4)


def test_empty_table(spark):
    assert fast(spark, []) == []
    assert fast(spark, [(1, None, 1)]) == []


def test_only_changed_parts_contribute():
    rng = np.random.default_rng(2)
    vectors = rng.integers(-9, 9, (50, 16))
    bounds = [0, 8, 16]
    before = rng.integers(0, 4, (50, 2)).astype(np.uint8)
    assert list(codebooks.contributions(vectors, before, before, bounds, 4)) == []
    after = before.copy()
    after[7, 1] = (after[7, 1] + 1) % 4
    got = {(p, e, k): x for p, e, k, x in codebooks.contributions(vectors, before, after, bounds, 4)}
    want = {(1, after[7, 1], -1): 1, (1, before[7, 1], -1): -1}
    for k, x in enumerate(vectors[7, 8:].tolist()):
        if x:
            want |= {(1, after[7, 1], k): x, (1, before[7, 1], k): -x}
    assert got == want
    whole = {(p, e, k): x for p, e, k, x in codebooks.contributions(vectors, None, after, bounds, 4)}
    assert sum(x for (p, _, k), x in whole.items() if k == -1 and p == 0) == 50


def test_limbs():
    for x in (0, 1, -1, 1 << 32, -(1 << 32) - 5, 10**50, -(10**50)):
        assert sum(limb << 32 * place for place, limb in codebooks.limbs(x)) == x


def test_vectors_do_not_move_between_rounds(spark):
    rng = np.random.default_rng(3)
    frame = spark.createDataFrame([(k, rng.normal(size=16).tolist(), 1) for k in range(200)], "vec_id long, embedding array<double>, label int")
    kept = codebooks.usable(frame)
    books = codebooks.initial(kept, 4, 4)
    held = codebooks.blocks(kept, books)
    codes = codebooks.cut_bucketed(held.select("block", "n"), "codes", ["block"], codebooks._buckets(held))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = held.join(codes, "block")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
