"""The range of keys in which a budget ends, for texts of any quality weight."""

import random

import pytest

from tidepool.llm import mixing


@pytest.mark.parametrize("word", ["7", "word"])
def test_no_range_is_large(spark, word):
    """Texts of digits have the least weight, so their keys lie far apart from those of others."""
    rng = random.Random(3)
    rows = [(k, " ".join([word] * rng.randrange(1, 9)), "ab"[k % 3 == 0]) for k in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    own = mixing.measured(docs, "text", "doc_id")
    own = own.selectExpr("source", "size", "draw", "-ln((shiftrightunsigned(draw, 11) + 1) / double(9007199254740992)) / quality AS key").cache()
    sizes = {r.source: (r.words, r.n) for r in own.groupBy("source").agg({"size": "sum", "draw": "count"}).toDF("source", "words", "n").collect()}
    plan = spark.createDataFrame([(s, w * 0.37, n) for s, (w, n) in sizes.items()], "s string, rest double, docs long")
    keys = {s: sorted((r.key, r["size"]) for r in own.where(f"source = '{s}'").collect()) for s in sizes}
    for r in mixing.ending_ranges(own, plan, most=64, parts=16).collect():
        below = sum(size for key, size in keys[r.s] if key < r.low)
        inside = [size for key, size in keys[r.s] if r.low <= key <= r.high]
        assert 0 < len(inside) <= 64
        assert abs(sizes[r.s][0] * 0.37 - below - r.left) < 1e-6
        assert 0 <= r.left < sum(inside)
    assert len(sizes) == 2


def test_taken_words_come_near_the_target(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(["1234" if k % 2 else "letters"] * rng.randrange(1, 30)), f"s{k % 5}") for k in range(12000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).toDF("source", "taken", "target").collect()
    assert len(got) == 5
    for r in got:
        assert abs(r.taken - r.target) <= 1
