"""Stemmed keyword search without diacritics, against SQLite's own tokenizer, and through the store."""

import sqlite3

import pyarrow as pa
import pytest

from tidepool.functions import stemming
from tidepool.operators import keyword
from tidepool.store import Store


def test_stemmed_search_equals_sqlite(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()]
    rows += [(9001, "She runs past the Café"), (9002, "running to cafes"), (9003, "naïve databases")]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", [(i + 1, t) for i, t in rows])
    docs = keyword.tokenised(spark.createDataFrame(rows, "id long, content string"), stemmed=True)
    want = {i - 1: -s for i, s in con.execute("""SELECT rowid, bm25(t) FROM t WHERE t MATCH '"run" OR "café" OR "database" OR "leetions"'""")}
    got = {r.id: r.score for r in keyword.search(docs, "run café database leetions", "or", stemmed=True).collect()}
    assert {9001, 9002, 9003} < set(got)
    assert got == pytest.approx(want, rel=1e-9)


def test_store_finds_inflected_and_accented_words(spark, tmp_path):
    clock = iter(range(1_700_000_000_000, 1_800_000_000_000, 1000))
    store = Store(spark, str(tmp_path / "store"), now=lambda: next(clock))
    own = store.store_memory("They were running towards the Café yesterday")
    for query in ("run", "cafe", "cafés", "runs"):
        assert [r.id for r in store.search_keyword(query).collect()] == [own]


def test_a_different_word_is_stemmed_once(monkeypatch):
    """Lists stay Arrow's, parted or sliced; only different words become Python's."""
    monkeypatch.setattr(stemming, "WORDS", 5)
    rows = [["runs", "cafés"], None, [], ["runs"] * 12, ["cafés", None]]
    asked = []
    got = stemming._each_word(pa.array([["gone"], *rows], pa.list_(pa.string()))[1:], lambda w: asked.append(w) or stemming.normal(w))
    assert got.to_pylist() == [["run", "cafe"], None, [], ["run"] * 12, ["cafe", None]]
    assert len(asked) <= 6 and stemming.normal.cache_info().maxsize <= 1 << 15
