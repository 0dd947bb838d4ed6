import random

import numpy as np
import pytest
import xxhash

from tidepool.llm import simhash
from tidepool.llm.components import connected_components


def slow_fingerprint(text, words=4):
    parts = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(prints, radius):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_documents_equal_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    prints = [slow_fingerprint(r.text) for r in rows]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    for r, p, c in zip(rows, prints, slow_classes(prints, 4)):
        assert got[r.doc_id] == (f"{p:016x}", rows[c].doc_id)


def test_nulls_empty_short_and_repeated(spark):
    rows = [(5, None, "a"), (3, "", "b"), (9, " \t ", "c"), (2, "One two", "d"), (8, "one  TWO", "e"), (8, "one  TWO", "e"), (None, "x", "f"), (None, "x", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bits string")
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    two, x = f"{slow_fingerprint('one two'):016x}", f"{slow_fingerprint('x'):016x}"
    zero = "0" * 16
    assert got == [(-1, x, None), (-1, x, None), (2, two, 2), (3, zero, 3), (5, zero, 3), (8, two, 2), (8, two, 2), (9, zero, 3)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0


@pytest.mark.parametrize("tile", [simhash.TILE, 16])
def test_links_of_planted_clusters(spark, tile):
    rng = random.Random(3)
    prints = []
    for size in (1, 1, 2, 5, 60, 130):
        centre = rng.getrandbits(64)
        for _ in range(size):
            p = centre
            for b in rng.sample(range(64), rng.randrange(0, 4)):
                p ^= 1 << b
            prints.append(p)
    chain = rng.getrandbits(64)
    for step in range(30):
        chain ^= 0xF << (2 * step)
        prints.append(chain)
    prints = sorted(set(prints))
    want = slow_classes(prints, 4)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "bits long")
    roots = {r.node % (1 << 64): r.root for r in connected_components(simhash.near_links(frame, tile=tile)).collect()}
    classes = {}
    for p, w in zip(prints, want):
        classes.setdefault(w, set()).add(roots.get(p, p))
    assert all(len(c) == 1 for c in classes.values())
    assert len({next(iter(c)) for c in classes.values()}) == len(classes)


@pytest.mark.parametrize("radius", [0, 3, 4, 7])
def test_carry_save_counters(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 1 << 63, 70, np.uint64)
    b = np.concatenate([a[:50] ^ (np.uint64(1) << rng.integers(0, 63, 50).astype(np.uint64)), a[50:] ^ np.uint64(0x7F)])
    want = {(i, j) for i in range(70) for j in range(70) if (int(a[i]) ^ int(b[j])).bit_count() <= radius}
    assert {(int(i), int(j)) for x, y in simhash.links_across(a, b, radius) for i, j in zip(x, y)} == want


def test_components_of_a_long_ordered_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in connected_components(links).collect()}
    assert len({roots[i] for i in range(301)}) == 1
    assert roots[1000] == roots[1001] != roots[0]
