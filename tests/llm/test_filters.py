"""The filter audit against a count of every order, and its corner cases."""

import math
import random
import re
from itertools import permutations

import pytest

from tidepool.llm import filters

LETTERS = "ABCDE"
SCHEMA = "doc_id long, text string, source string, mask string, part int, `a.b` int"


def slow(docs, labels):
    """Apply the filters to the rows themselves, in every order."""
    failed = []
    for i, text, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }
        good, toxic = (any(row[0] == i and row[k] == 1 for row in labels if i is not None) for k in (1, 2))
        failed.append((source or "", {x for x in LETTERS if fails[x]}, good, toxic))
    out, shares = [], {}
    for part in sorted({f[0] for f in failed}):
        own = [f for f in failed if f[0] == part]
        for order in permutations(LETTERS):
            gone = [False] * len(own)
            for step, x in enumerate(order, 1):
                hit = [k for k, f in enumerate(own) if x in f[1]]
                fresh = [k for k in hit if not gone[k]]
                for k in fresh:
                    gone[k] = True
                shares[part, x] = shares.get((part, x), 0) + len(fresh)
                alone = sum(f[1] == {x} for f in own)
                out.append([part, "".join(order), step, gone.count(False), len(fresh), len(hit) - len(fresh), alone, sum(own[k][2] for k in fresh), sum(own[k][3] for k in fresh), x])
    return sorted((*r[:-1], shares[r[0], r[-1]]) for r in out)


def text(rng):
    words = [f"w{rng.randrange(rng.choice([40, 2000]))}" for _ in range(rng.choice([0, 3, 199, 200, 260, 400]))]
    if rng.random() < 0.3:
        words = [w.upper() for w in words]
    return rng.choice([" ", "\n", "\t "]).join(words) + rng.choice(["", "", " #", "|", "é\x0b"])


def test_all_orders(spark):
    rng = random.Random(11)
    texts = [text(rng) for _ in range(60)]
    docs = [(rng.choice([*range(50), None]), rng.choice([*texts, None, ""]), rng.choice(["a", "b", "", None, "é"])) for _ in range(150)]
    labels = [(rng.choice([*range(50), None]), rng.choice([0, 1, None]), rng.choice([0, 0, 1, None])) for _ in range(40)]
    frame = spark.createDataFrame([(*d, "x", 5, 7) for d in docs], SCHEMA)
    got = filters.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert sorted(tuple(r) for r in got) == slow(docs, labels)


def test_limits_of_the_filters(spark):
    rows = [("A", " ".join(f"w{k}" for k in range(199))), ("", " ".join(f"w{k}" for k in range(200)))]
    rows += [("B", " ".join(f"w{k % 99}" for k in range(200))), ("", " ".join(f"w{k % 100}" for k in range(200)))]
    filler = " ".join(f"w{k}" for k in range(300))
    upper = len(filler) * 2 // 98
    rows += [("C", filler + "Z" * (upper + 1)), ("", filler + "Z" * upper), ("D", filler + " &"), ("", filler + " @ ! \x00 ")]
    frame = spark.createDataFrame([(k, t, "s") for k, (_, t) in enumerate(rows)], "doc_id long, text string, source string")
    got = {r.doc_id: r.mask for r in filters.failures(frame).collect()}
    assert got == {k: sum(1 << LETTERS.index(x) for x in want) for k, (want, _) in enumerate(rows)}


def test_empty_tables_and_very_long_texts(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    long = " ".join(f"word{k}" for k in range(300_000))
    frame = spark.createDataFrame([(1, long, "s"), (2, long, "s"), (2, long, "s")], "doc_id long, text string, source string")
    assert filters.audit(frame.where("doc_id = 9"), labels).count() == 0
    got = filters.audit(frame, labels).collect()
    assert len(got) == 600
    assert {(r.filter_order[r.step - 1], r.removed, r.shapley) for r in got} == {("E", 2, 240), *((x, 0, 0) for x in "ABCD")}


def test_other_filters(spark):
    frame = spark.createDataFrame([(1, "a b", "s"), (2, "a", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = filters.audit(frame, labels, {"x": lambda t, w: t.contains("b"), "y": lambda t, w: t.contains("a")}, copies=None).collect()
    assert sorted((r.filter_order, r.step, r.kept, r.removed, r.good_lost, r.shapley) for r in got) == [("xy", 1, 1, 1, 1, 1), ("xy", 2, 0, 1, 0, 3), ("yx", 1, 0, 2, 1, 3), ("yx", 2, 0, 0, 0, 1)]


@pytest.mark.parametrize("seed", range(5))
def test_polynomial(seed):
    rng = random.Random(seed)
    counts = {m: rng.randrange(5) for m in range(32)}
    polynomial = filters.removal_polynomial(counts, 5)
    for chosen in range(32):
        assert filters.corner(polynomial, chosen) == sum(c for m, c in counts.items() if m & chosen)
    for k in range(5):
        assert filters.shapley(polynomial, 1 << k) * 60 == sum(60 // m.bit_count() * c for m, c in counts.items() if m >> k & 1)
    assert sum(filters.shapley(polynomial, 1 << k) for k in range(5)) == sum(c for m, c in counts.items() if m)
    assert math.factorial(5) % 60 == 0
