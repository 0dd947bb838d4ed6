import random
import zlib

import numpy as np
import pytest

from tidepool.llm import linear, quality, queries, topk, toxicity


def held_out(rows):
    return [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]


def test_quality_on_held_out_rows(spark):
    data = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = queries.op8_quality_classifier(spark, data).collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    judged = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in judged]) > 0.9


def test_quality_of_odd_rows(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice(["Some", "words", "here."]) for _ in range(30)) if i % 2 else "BUY!! NOW!! " * 9, "x", 0.5) for i in range(80)]
    docs = spark.createDataFrame([*rows, (100, None, "x", 1.0), (101, "", "y", 1.0), (None, "Some words", "z", None)], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(got) == 83
    assert all(got[i].predicted == i % 2 for i in range(80))
    assert 0 <= got[100].score == got[101].score <= 1
    one = quality.fit(docs, labels.where("quality = 1"))
    assert {r.predicted for r in quality.score(docs, one).collect()} == {1}
    none = quality.fit(docs, labels.limit(0))
    assert quality.score(docs.limit(0), none).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns


def test_shape_features_stand_for_shapes():
    def features(*texts):
        raw = [t.encode() for t in texts]
        return quality.shape_features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))

    a, b, c, d = features("Word, word", "Other, thing", "", "Word, Word,")
    assert list(a) == list(b) != list(d)
    assert list(c) == [0]
    alone = [features(t)[0].tolist() for t in ("Word, word", "Other, thing", "Word, Word,")]
    assert alone == [a.tolist(), b.tolist(), d.tolist()]


def test_dual_coordinate_descent_meets_the_optimum():
    rng = np.random.default_rng(1)
    rows = linear.rows_of([np.flatnonzero(rng.random(8) < 0.5) for _ in range(60)])
    labels = rows.dot(np.array([3, -2, 1, 0, 0, 1, -1, 0.5])) > 0.4
    scale = np.linspace(0.5, 2, 8)
    w, b = linear.dual_coordinate_descent(rows, scale, labels, 1.0, 2000, balance=False, tolerance=1e-9)

    def loss(w, b):
        margin = rows.dot(w * scale) + b
        return 0.5 * (w @ w + b * b) + (np.maximum(0, 1 - np.where(labels, 1, -1) * margin) ** 2).sum()

    best = loss(w, b)
    for _ in range(200):
        assert best <= loss(w + rng.normal(0, 0.01, 8), b + rng.normal(0, 0.01)) + 1e-6


def test_logistic_finds_the_word():
    rng = np.random.default_rng(2)
    lists = [np.flatnonzero(rng.random(30) < 0.3) for _ in range(400)]
    labels = np.array([7 in x for x in lists])
    w = linear.logistic(linear.rows_of(lists), np.zeros((400, 1)), labels, 30)
    assert w[7] == max(w)
    assert np.mean((linear.rows_of(lists).dot(w[:30]) + w[-1] > 0) == labels) == 1


def test_toxicity_on_held_out_rows(spark):
    data = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    chain = toxicity.fit(docs, quality.training_rows(labels))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in held_out(toxicity.score(docs, chain).collect()) if r.doc_id in truth]
    caught = [r.predicted for r in rows if truth[r.doc_id]]
    false = [r.predicted for r in rows if not truth[r.doc_id]]
    assert np.mean(caught) > 0.75
    assert np.mean(false) < 0.02


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (None, "word", None), (1, None, 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == 4
    assert all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels)).count() == 0


def slow_top(rows, k, dims_of=len):
    out = []
    for q, v in sorted({i: v for i, v in rows if i % 100 == 0}.items()):
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return out


@pytest.mark.parametrize("block", [topk.BLOCK, 40])
def test_top_k_with_ties_and_odd_vectors(spark, block):
    rng = random.Random(4)
    vectors = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.3]) for _ in range(6)]) for i in range(230)]
    vectors += [(300, [0.0] * 6), (400, [1.0] * 5), (401, [0.5] * 5), (500, [1.0])]
    odd = [(600, None), (700, [1.0, None] * 3), (800, [float("nan")] * 6), (900, [float("inf")] * 6), (None, [1.0] * 6)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in vectors + odd], "vec_id long, embedding array<float>, rank string")
    whole = topk.quantised(frame)
    got = sorted(tuple(r) for r in topk.top_k(whole, whole.where("vec_id % 100 = 0"), 10, block).collect())
    exact = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in vectors]
    assert got == sorted(slow_top(exact, 10))
    assert topk.top_k(whole.limit(0), whole.limit(0)).count() == 0


def test_threshold_algorithm_stops_early():
    rng = np.random.default_rng(0)
    vectors = rng.integers(0, 50, (4000, 4))
    vectors[:20] += 500
    lists = topk.SortedLists(np.arange(4000), vectors)
    got = lists.search(-1, np.array([3, 1, 2, 1]), 10)
    scores = vectors @ np.array([3, 1, 2, 1])
    assert [s for s, _ in got] == sorted(scores.tolist(), reverse=True)[:10]
    assert lists.reads < 1000
