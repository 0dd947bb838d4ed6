import random

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_simhash import slow_fingerprint
from tidepool.llm import closecopies, simhash


def shingles(text, words=5):
    parts = (text or "").lower().split()
    return {tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def slow_classes(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def edited(rng, words, changes):
    out = list(words)
    for k in rng.sample(range(len(out)), changes):
        out[k] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("tile", [closecopies.TILE, 8])
def test_stage_equals_brute_force(spark, monkeypatch, tile):
    """Copies around a similarity of 0.8, most of them further apart than 4 bits, chains and a crowded pool."""
    rng = random.Random(5)
    texts = []
    for n, copies, changes in ((60, 40, 1), (200, 20, 4), (200, 12, 3), (120, 12, 2), (400, 6, 12)):
        base = [f"b{rng.randrange(10**6)}" for _ in range(n)]
        texts += [" ".join(base), *(edited(rng, base, changes) for _ in range(copies))]
    texts += ["short text", "Short  TEXT", "", " ", "another short one"]
    rng.shuffle(texts)
    classes = slow_classes(texts)
    linked = [(i, c) for i, c in enumerate(classes) if i != c]
    assert any((slow_fingerprint(texts[i]) ^ slow_fingerprint(texts[c])).bit_count() > 4 for i, c in linked)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    if tile != closecopies.TILE:
        kept = closecopies.first_of_each(docs, tile=tile)
    else:
        kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, c in enumerate(classes) if i == c]


def test_repeated_and_null_ids(spark):
    """One row of each class, whatever its ids: rows of one id that are no copies both stay, null ids are deduplicated too."""
    rows = [(3, "one two", "a"), (3, "quite another text", "b"), (None, "x y z", "c"), (None, "X y z", "d"), (None, "one two", "e"), (3, "one two", "a"), (2, None, "f"), (None, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.doc_id or 0, (r.text or "").lower()) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == [(0, "x y z"), (2, ""), (3, "one two"), (3, "quite another text")]


def test_unrelated_texts_make_no_pool(spark):
    """Not at a hundred billion texts by calculation, where 128 bits would join most of 15 million; and not of thousands that are drawn."""
    assert simhash.unrelated_within(256, closecopies.RADIUS) * 1e11 < 1e-4
    assert simhash.unrelated_within(128, 36) * 15e6 > 1
    rng = np.random.default_rng(7)
    prints = rng.integers(-(1 << 63), 1 << 63, (20_000, closecopies.PRINT_WORDS), dtype=np.int64)
    frame = spark.createDataFrame(prints.tolist(), ", ".join(f"{c} long" for c in closecopies.PRINT))
    assert simhash.wide_links(frame, closecopies.RADIUS, closecopies.AGREE).count() == 0


def test_recall_by_calculation_and_at_hand(spark):
    """All pairs at 0.8 or more among the different texts of a table are candidates, with as many keys as 15 million texts get."""
    docs = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").distinct().collect()]
    sets = [closecopies.shingle_set(t.encode()) for t in docs]
    pairs = closecopies.spanning_links(sets, np.zeros(len(sets), int), False)
    prints = np.array([simhash.wide_fingerprint(s, closecopies.PRINT_WORDS) for s in sets], np.uint64)
    width, count = simhash.keys_for(15_000_000, closecopies.AGREE, 1e-3)
    keys = simhash.sampled_keys(prints, width, count)
    for a, b in pairs:
        assert (keys[a] == keys[b]).any()
        assert sum((int(x) ^ int(y)).bit_count() for x, y in zip(prints[a], prints[b])) <= closecopies.RADIUS
    assert len(pairs) > 2
