import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidepool.llm import repeats

SCHEMA = "doc_id long, text string, k1 string"


def gone_bytes(raws, length):
    """Per text which of its bytes go, window by window."""
    seen = {}
    for raw in raws:
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] = seen.get(raw[i : i + length], 0) + 1
    for raw in raws:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        yield raw, gone


def brute(texts, length):
    """Per text (n_bytes, n_removed, n_spans, kept sha-256)."""
    out = []
    for raw, gone in gone_bytes([(t or "").encode() for t in texts], length):
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int(np.sum(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
        out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def planted(seed):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice("abcdefghij éß\n") for _ in range(n))
    passage, long_one = prose(70), prose(300)
    texts = [prose(rng.randrange(0, 300)) for _ in range(12)]
    texts += [prose(rng.randrange(60)) + passage[: rng.randrange(35, 70)] + prose(rng.randrange(60)) for _ in range(12)]
    texts += [prose(9) + passage + prose(rng.randrange(80)) for _ in range(30)]
    texts += ["ab" * 90, "ab" * 20 + "x", "Der " * 60 + prose(20), "xyz" * 13 + "Der " * 11, "a" * 200, "a" * 40, "a" * 39]
    texts += [long_one] * 5 + [long_one[:150] + "!" + long_one[150:], long_one[10:290], long_one + long_one[:100]]
    texts += [None, "", " ", "short"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "crowd"), [(1, 128), (2, 3), (3, 128), (4, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, crowd):
    monkeypatch.setattr(repeats.repeated_spans, "__defaults__", (repeats.LENGTH, repeats.GRAM, crowd))
    texts = planted(seed)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA)
    found = repeats.without_repeats(docs, length=40, gram=8)
    own = docs.select("doc_id", *repeats.text_keys("text"))
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in own.join(found, ["k1", "k2"]).collect()}
    for i, want in enumerate(brute(texts, 40)):
        assert rows[i] == want, (i, texts[i])


def test_default_length_on_the_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.removals(docs).collect()}
    texts = docs.orderBy("doc_id").collect()
    for d, want in zip(texts, brute([d.text for d in texts], 400)):
        assert rows[d.doc_id] == want


def test_long_texts_are_taken_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 100)
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh") for _ in range(900))
    texts = [text, text[500:700], "ab" * 300, text[:90]]
    buffers = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    import pyarrow as pa

    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            n = len(texts)
            batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array([1] * n), pa.array([t.encode() for t in texts])], names=list("abcd"))
            return [r for out in run(iter([batch])) for r in out.to_pylist()]

    rows = repeats.anchor_rows(Frame(), 40, 8)
    for k, b in enumerate(buffers):
        own = [r for r in rows if r["k1"] == k and r["gram"] is not None]
        windows = sorted(w for r in own for w in range(r["low"], r["high"] + 1))
        assert len(windows) == len(set(windows))
        if k != 2:
            assert windows == list(range(len(b) - 39))


def test_deduplicated_keeps_rows_columns_and_whole_characters(spark):
    passage = "é" * 250
    rows = [(1, "x" + passage, 7), (2, passage + "y", 8), (2, passage + "y", 8), (3, None, 0), (None, "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = repeats.deduplicated(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id or -1, r.text, r.n_chars) for r in out.collect())
    assert got == [(-1, "z", 1), (1, "x", 1), (2, "", 0), (2, "", 0), (3, "", 0)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.removals(docs).count() == 0
    assert repeats.deduplicated(docs).count() == 0


def test_maximal_repeats_have_all_occurrences():
    contexts, offsets = [b"aaXYZbb", b"caXYZbd", b"eaXYZff", b"ggXYgg"], [2, 2, 2, 2]
    found = {(c[o - left : o + right], tuple(sorted(m))) for left, right, m in repeats.maximal_repeats(contexts, offsets, 3) for c, o in [(contexts[m[0]], offsets[m[0]])]}
    assert found == {(b"aXYZ", (0, 1, 2)), (b"aXYZb", (0, 1))}


def repeated_words(texts, passage):
    """Per text how many of its words stand in a run of so many that also starts elsewhere."""
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    seen = Counter(tuple(w[i : i + passage]) for w in split for i in range(len(w) - passage + 1))
    for words in split:
        gone = set()
        for i in range(len(words) - passage + 1):
            if seen[tuple(words[i : i + passage])] > 1:
                gone.update(range(i, i + passage))
        yield len(gone)


@pytest.mark.parametrize(("seed", "crowd", "piece"), [(1, 256, repeats.PIECE), (2, 2, repeats.PIECE), (3, 2, 303)])
def test_passages_of_over_50_words_are_told_whatever_their_bytes(spark, monkeypatch, seed, crowd, piece):
    monkeypatch.setattr(repeats, "PIECE", piece)
    monkeypatch.setattr(repeats.repeated_spans, "__defaults__", (repeats.LENGTH, repeats.GRAM, crowd))
    rng = random.Random(seed)
    words = lambda n: ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6))) for _ in range(n)]
    prose = lambda n: "".join(w + rng.choice([" ", "\n", "\t ", "  "]) for w in words(n))
    passage = words(90)
    texts = [prose(rng.randrange(0, 120)) for _ in range(10)]
    for _ in range(30):
        n, at = rng.choice([49, 50, 51, 52, 60, 90]), rng.randrange(30)
        texts.append(prose(rng.randrange(40)) + rng.choice([" ", "\n"]).join(passage[at : at + n]) + " " + prose(rng.randrange(40)))
    whole = prose(60)
    texts += ["a " * 51, "a " * 52, "a b " * 60, whole, whole, whole.replace("\n", " "), "kurz", "kurz", " ", "", None, prose(70) * 2]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA)
    rows = {r.doc_id: r for r in repeats.removals(docs).collect()}
    wanted = list(repeated_words(texts, 51))
    assert [rows[i].n_repeated_words for i in range(len(texts))] == wanted
    assert any(rows[i].n_repeated_words and not rows[i].n_removed for i in range(len(texts)))
    for i, want in enumerate(brute(texts, 400)):
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) == want


def test_codes_of_words_in_pieces(monkeypatch):
    texts = [b"", b"one two", b" three\n" + b"x" * 90 + b" one", b"", b"two " * 20]
    buffer, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole, places = repeats.word_codes(buffer, offsets)
    assert (np.diff(places) // repeats.CODE).tolist() == [len(t.split()) for t in texts]
    monkeypatch.setattr(repeats, "PIECE", 30)
    again, same = repeats.word_codes(buffer, offsets)
    assert same.tolist() == places.tolist()
    words = b" ".join(texts).split()
    for codes in (whole, again):
        rows = codes.reshape(-1, repeats.CODE)
        assert len({w: rows[k].tobytes() for k, w in enumerate(words)}) == len({r.tobytes() for r in rows}) == len(set(words))
    short = [k for k, w in enumerate(words) if len(w) <= 30]
    assert np.array_equal(whole.reshape(-1, repeats.CODE)[short], again.reshape(-1, repeats.CODE)[short])
