"""The kept keyword index against the search that reads texts, and what a search of it reads."""

import random

import pytest
from pyspark.sql import functions as F

from tidepool.operators import index, keyword


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    words = ["apple", "pear", "of", "the", "plum", "fig", "kiwi-fruit", "nut"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for k in range(300)] + [(1000, None), (1001, ""), (1002, "the the the pear")]
    return keyword.tokenised(spark.createDataFrame(rows, "id long, content string")).selectExpr("id", "int(id % 2) AS kind", "tokens").cache()


@pytest.fixture(scope="module")
def kept(spark, docs, tmp_path_factory):
    """Appended in seven pieces, some of which merged, with documents removed, removed and appended again, and changed."""
    made = index.KeywordIndex(spark, str(tmp_path_factory.mktemp("index")))
    stale = docs.selectExpr("id", "kind", "array('apple', 'stale') AS tokens")
    made.append(stale.where("id < 20"))
    for low in range(0, 250, 50):
        if low == 0:
            assert made.remove(stale.where("id < 20")) == 20
        made.append(docs.where(f"id >= {low} AND id < {low + 50}"))
    made.append(stale.where("id IN (5000, 250, 251)").unionByName(docs.where("id >= 250")))
    made.remove(docs.where("id IN (250, 251, 7)"))
    made.append(docs.where("id IN (250, 251, 7)"))
    return index.KeywordIndex(spark, made.folder)


@pytest.mark.parametrize("tier", ["and", "or", "tiered"])
@pytest.mark.parametrize("query", ["apple pear", "the pear of", "kiwi-fruit fig", "the-the", "zzz apple", "zzz", "", "fruit-kiwi pear-pear"])
def test_equals_search_of_texts(docs, kept, query, tier):
    want = {r.id: r.score for r in keyword.search(docs, query, tier).collect()}
    got = {r.id: r.score for r in kept.search(query, tier).collect()}
    assert got == pytest.approx(want, rel=1e-12)


def test_reads_only_the_folders_of_its_terms(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "_files", lambda frame: 8)
    many = index.KeywordIndex(spark, str(tmp_path / "many"))
    many.append(docs)
    assert many.segments[0]["shards"] == 8
    plan = many.postings(["apple"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and "PushedFilters" in plan
    folders = lambda frame: {r.f.split("shard=")[1].split("/")[0] for r in frame.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(folders(many._blocks_of(["apple"]))) == 1 < len(folders(many._blocks_of(None)))
    want = sorted((r.term, r.id, r.tf) for r in index.postings(docs).collect())
    assert sorted((r.term, r.id, r.tf) for r in many.all_postings().collect()) == want


def test_totals_are_told_without_reading(docs, kept):
    assert kept.stats()[0] == docs.count() == kept.documents().count()
    assert kept.stats()[1] == pytest.approx(docs.selectExpr("avg(size(tokens)) AS a").first().a)
    assert len(kept.segments) <= 5


def test_files_are_dealt_by_size():
    assert [index.dealt(n) for n in (1, 2, 8, 64)] == [(1, 0), (2, 0), (8, 0), (64, 0)]
    shards, bits = index.dealt(1_000_000)
    assert shards == 4096 and 1_000_000 // 2 <= shards << bits <= 1_000_000


def test_segments_of_a_thousand_appends():
    levels = []
    for _ in range(1000):
        levels.append(0)
        while chosen := index.merges(levels):
            level = levels[chosen[0]]
            levels = [x for k, x in enumerate(levels) if k not in chosen] + [level + 1]
        assert len(levels) <= 12


def test_a_removal_writes_no_segment(spark, docs, tmp_path):
    made = index.KeywordIndex(spark, str(tmp_path / "index"))
    made.append(docs)
    before = sorted(p.name for p in (tmp_path / "index" / "segments").iterdir())
    assert made.remove(docs.where("id < 150").unionByName(docs.selectExpr("id + 100000 AS id", "kind", "tokens"))) == 150
    assert sorted(p.name for p in (tmp_path / "index" / "segments").iterdir()) == before
    assert made.stats()[0] == docs.count() - 150
    want = {r.id: r.score for r in keyword.search(docs.where("id >= 150"), "apple pear", "or").collect()}
    assert {r.id: r.score for r in made.search("apple pear", "or").collect()} == pytest.approx(want, rel=1e-12)
    made.append(docs.where("id < 3"), batch=4)
    made.append(docs.where("id < 3"), batch=4)
    assert made.stats()[0] == docs.count() - 147


def test_sync_writes_what_changed(spark, docs, tmp_path, monkeypatch):
    made = index.KeywordIndex(spark, str(tmp_path / "index"))
    monkeypatch.setattr(index.merges, "__defaults__", (9,))
    made.append(docs.where("kind = 1"))
    other = docs.where("kind = 0").selectExpr("id", "kind", "IF(id = 4, array('new'), tokens) AS tokens")
    made.sync(docs.where("kind = 0"), 0, "a")
    made.sync(other.where("id <> 6"), 0, "b")
    assert made.covers == "b" and min(s["n"] for s in made.segments) == 1
    got = index.KeywordIndex(spark, made.folder)
    assert [r.id for r in got.search("new").collect()] == [4]
    assert got.stats()[0] == docs.count() - 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batches_with_pruning(spark, tmp_path_factory, seed, monkeypatch):
    """Skewed words: frequent ones are read for a small part, and the result is that of all postings."""
    monkeypatch.setattr(index, "SEED", 64)
    monkeypatch.setattr(index, "CHEAP", 0)
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    draw = lambda n: [words[min(299, int(rng.paretovariate(0.8)) - 1)] for _ in range(n)]
    rows = [(k, k % 2, draw(rng.choice([3, 10, 60]))) for k in range(3000)]
    docs = spark.createDataFrame(rows, "id long, kind int, tokens array<string>").cache()
    made = index.KeywordIndex(spark, str(tmp_path_factory.mktemp("pruned")))
    for k in range(4):
        made.append(docs.where(f"id % 4 = {k}"))
    gone = docs.where("id % 10 = 3")
    made.remove(gone)
    asked = spark.createDataFrame([(q, t) for q in range(12) for t in sorted({words[q], words[rng.randrange(5, 100)], words[rng.randrange(100, 300)]})], "query_id long, term string")
    left = docs.where("id % 10 <> 3")
    want = keyword.search_batch(keyword.postings(left), keyword.doc_stats(left), asked, 5).collect()
    batch = index.Batch(made, asked, 5, 9)
    key = lambda r: (r.query_id, r["rank"], r.id, round(r.score, 9))
    assert sorted(map(key, batch.best.collect())) == sorted(map(key, want))
    # what is read as a whole; with so few documents the blocks that are looked up are most of a term
    told = batch.judged.groupBy("counts").agg(F.sum("n").alias("n")).collect()
    kept = {r.counts: r.n for r in told}
    assert kept[True] < kept[False] / 2
    monkeypatch.setattr(index, "CHEAP", 1 << 15)
    assert sorted(map(key, made.search_batch(asked, 5).collect())) == sorted(map(key, want))


def test_lookups_read_a_small_part_of_a_frequent_term(spark, tmp_path, monkeypatch):
    """Two rare words and one that is in every document: its few blocks that hold the hashes of candidates are read."""
    monkeypatch.setattr(index, "CHEAP", 1000)
    rows = spark.range(60_000).selectExpr("id", "0 AS kind", "IF(id % 3000 = 7, array('the', 'rare', 'the'), IF(id % 2900 = 5, array('the', 'other'), array('the', 'x', 'y'))) AS tokens")
    made = index.KeywordIndex(spark, str(tmp_path / "index"))
    made.append(rows)
    asked = spark.createDataFrame([(1, "the"), (1, "rare"), (1, "other")], "query_id long, term string")
    batch = index.Batch(made, asked, 5, 9)
    want = keyword.search_batch(keyword.postings(rows), keyword.doc_stats(rows), asked, 5).collect()
    assert sorted((r["rank"], r.id, round(r.score, 9)) for r in batch.best.collect()) == sorted((r["rank"], r.id, round(r.score, 9)) for r in want)
    read, n = batch.read.where("term = 'the'").select("read", "n").first()
    assert n == 60_000 and read < n / 3


def test_batches(docs, kept):
    asked = kept.spark.createDataFrame([(1, "apple"), (1, "fig"), (2, "the"), (3, "zzz")], "query_id long, term string")
    want = keyword.search_batch(keyword.postings(docs), keyword.doc_stats(docs), asked, 5).collect()
    got = kept.search_batch(asked, 5).collect()
    key = lambda r: (r.query_id, r["rank"], r.id, round(r.score, 9))
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) == 10


def test_empty(spark, docs, tmp_path):
    made = index.KeywordIndex(spark, str(tmp_path / "none"))
    made.append(docs.where("id < 0"))
    asked = spark.createDataFrame([(1, "apple")], "query_id long, term string")
    assert made.search("apple").count() == 0 and made.search_batch(asked).count() == 0 and made.stats() == (0, None)
    made.append(docs.where("id = 1001"))
    assert made.search("apple").count() == 0 and made.search_batch(asked).count() == 0 and made.stats() == (1, 0.0)


def test_postings_move_packed(spark, docs):
    """A term of many documents moves in few rows, and what is unpacked and packed again is the same."""
    rows = docs.coalesce(1)
    made = index.packed(rows, 1).collect()
    one = {(r.term, r.part) for r in made}
    assert len(made) == len(one) < index.postings(rows).count() / 10 and {p for _, p in one} == {0, 1}
    again = index.repacked(index.postings(rows).coalesce(1), 1).collect()
    key = lambda r: (r.term, r.part)
    assert sorted(again, key=key) == sorted(made, key=key)


def test_many_queries_by_ranges(spark, docs, kept):
    """Queries of equal terms are scored once, a posting moves once; removed documents, several segments and ties included."""
    words = ["apple", "pear", "of", "the", "plum", "fig", "kiwi", "fruit", "nut", "zzz"]
    asked = spark.createDataFrame([(q, words[(q * k + k) % 10]) for q in range(40) for k in (1, 2, 5)], "query_id long, term string").distinct()
    want = keyword.search_batch(keyword.postings(docs), keyword.doc_stats(docs), asked, 5).collect()
    found = index.by_ranges(kept, asked, 5, 9, tokens=1000)
    key = lambda r: (r.query_id, r["rank"], r.id, round(r.score, 9))
    assert sorted(map(key, found.collect())) == sorted(map(key, want)) and len(want) == 200
    assert sorted(map(key, kept.search_batch(asked, 5).collect())) == sorted(map(key, want))
    copies = docs.where("id < 3").selectExpr("explode(sequence(0, 199)) AS id", "0 AS kind", "array('same', 'text') AS tokens").distinct()
    kept_copies = index.KeywordIndex(spark, kept.folder + "-copies")
    kept_copies.append(copies)
    got = index.by_ranges(kept_copies, spark.createDataFrame([(1, "same"), (2, "same")], "query_id long, term string"), 3, 9, tokens=50).collect()
    assert sorted((r.query_id, r["rank"], r.id) for r in got) == [(q, k + 1, k) for q in (1, 2) for k in range(3)]
