"""Components and products beyond 64 bits, and floors from a first round."""

import math
import random

import numpy as np

from tidepool.llm import topk


def slow(vectors, queries, k):
    out = []
    for q, own in queries.items():
        scores = sorted((-sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(own, v)), i) for i, v in vectors.items() if i != q and len(v) == len(own))
        out += [(q, rank, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_huge_components(spark):
    vectors = {100: [1.0, 2.0], 1: [-1e18, 2.0], 2: [1e300, -1e300], 3: [2.5e12, 0.1], 4: [-0.3, 7.0], 5: [1e-320, 0.0], 200: [-1e200, 3.0], 300: [0.0, 0.0], 7: [1.0, 2.0, 3.0]}
    frame = spark.createDataFrame([(i, v) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    whole = topk.quantised(frame)
    got = sorted(tuple(r) for r in topk.top_k(whole, whole.where("vec_id % 100 = 0"), 10, 2).collect())
    want = slow(vectors, {i: v for i, v in vectors.items() if i % 100 == 0}, 10)
    beyond = {1 << 63, -(1 << 63), (1 << 63) - 1}
    assert [r for r in got if r[3] not in beyond] == [r for r in want if r[3] not in beyond]
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted((r[0], r[2], r[3]) for r in want)


def test_floors_of_many_blocks(spark):
    rng = random.Random(9)
    vectors = {i: [rng.choice([0.0, 0.25, -0.5, rng.random() - 0.5]) for _ in range(4)] for i in range(900)}
    vectors |= {1000 + i: [0.25, 0.25, -0.5, 0.25] for i in range(300)}
    frame = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    whole = topk.quantised(frame)
    got = sorted(tuple(r) for r in topk.top_k(whole, whole.where("vec_id % 100 = 0"), 10, 64).collect())
    assert got == slow(vectors, {i: v for i, v in vectors.items() if i % 100 == 0}, 10)


def test_a_floor_ends_a_search_early():
    rng = np.random.default_rng(1)
    lists = topk.SortedLists(np.arange(5000), rng.normal(0, 100, (5000, 8)).round())
    query = rng.normal(0, 100, 8).round()
    best = lists.search(-1, query, 10)
    reads, lists.reads = lists.reads, 0
    assert lists.search(-1, query, 10, best[0][0]) == [x for x in best if x[0] >= best[0][0]]
    assert lists.reads <= reads
    lists.reads = 0
    assert lists.search(-1, query, 10, 10**9) == [] and lists.reads == 0


def test_odd_tables(spark):
    """Null, empty and odd vectors, repeated rows, ties, clashing columns, and an empty table."""
    names = ["vec_id", "embedding", "VEC_ID", "v", "c", "score", "a.b"]
    rows = [(100, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 0.0]), (None, [1.0, 1.0]), (5, []), (6, [1.0]), (7, [0.5, 9.0]), (200, [])]
    plain = spark.createDataFrame([(i, v, "x", "y", 1, 2, 3) for i, v in rows], "c0 long, c1 array<double>, c2 string, c3 string, c4 int, c5 int, c6 int")
    whole = topk.quantised(plain.toDF(*names))
    got = sorted(tuple(r) for r in topk.top_k(whole, whole.where("vec_id % 100 = 0"), 10).collect())
    assert got == [(100, 1, 1, 1 << 20), (100, 2, 1, 1 << 20), (100, 3, 7, 1 << 19), (200, 1, 5, 0)]
    none = whole.where("vec_id < 0")
    assert topk.top_k(none, none).count() == 0 and topk.top_k(whole, none).count() == 0
