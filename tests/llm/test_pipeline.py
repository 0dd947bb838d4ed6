"""The pipeline against a brute-force version of each stage, each on its own input."""

import base64
import hashlib
import math

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
import zlib

import corpus_pipeline
from tests.llm.test_closecopies import slow_classes
from tests.llm.test_repeats import gone_bytes
from tests.llm.test_texts import water
from tidepool.llm import mixing, quality
from tidepool.llm.linear import rows_of
from tidepool.llm.scratch import cut

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = cut(stage(spark, docs, DATA), name)
        out.append((docs, made))
        docs = made
    return out


def rows(frame):
    return sorted(frame.collect(), key=lambda r: (r.doc_id, r))


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "suffix_array_dedup", "mix_sources", "byte_bpe"]
    for docs, made in stages[:-1]:
        assert made.columns == docs.columns
        assert made.count() > 0


def test_rejection(spark, stages):
    docs, made = (rows(x) for x in stages[0])
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    features = {d.doc_id: x for d in docs for part in quality.features_of(pa.array([d.text.encode()])) for x in part}
    learned = [i for i in known if zlib.crc32(str(i).encode()) % 4 != 2]

    def place(i):
        h = xxhash.xxh64_intdigest(str(i).encode(), 42)
        h = _int_hash(11, h)
        return h - (1 << 64) if h >> 63 else h

    order = sorted(learned, key=place)
    model = quality.fit_rows(rows_of([features[i] for i in order]), np.array([known[i] == 1 for i in order]))
    small = quality.Model(model.weights.astype(np.float32), model.bias, model.slope, model.offset)
    p = small.probability(rows_of([features[d.doc_id] for d in docs]))
    assert made == [d for d, score in zip(docs, p) if score >= 0.7]


def _int_hash(value, seed):
    """XXH64 of a 4-byte integer as Spark hashes it."""
    return xxhash.xxh64_intdigest(value.to_bytes(4, "little"), seed)


def test_near_copies(stages):
    """No contract fixes this stage, so it takes five words and a similarity of 0.8."""
    docs, made = (rows(x) for x in stages[1])
    classes = slow_classes([d.text for d in docs])
    assert made == [d for k, d in enumerate(docs) if classes[k] == k]


def test_repeats(stages):
    docs, made = (rows(x) for x in stages[2])
    assert [m.doc_id for m in made] == [d.doc_id for d in docs]
    shortened = 0
    for m, d, (raw, gone) in zip(made, docs, gone_bytes([d.text.encode() for d in docs], corpus_pipeline.REPEAT), strict=True):
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        assert m.text == kept.decode("utf-8", "ignore")
        assert m.n_chars == len(m.text)
        shortened += bool(gone.any())
    assert shortened


def slow_mix(docs):
    """doc_id to the number of times it is taken."""
    parts = {}
    for d in docs:
        text = d.text or ""
        dark = [b for b in text.lower().encode() if b not in b" \t\n\x0b\x0c\r"]
        weight = 0.1 + 0.9 * sum(97 <= b < 123 or b > 127 for b in text.encode().lower() if b not in b" \t\n\x0b\x0c\r") / max(1, len(dark))
        draw = xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(str(d.doc_id).encode(), 42))
        key = -math.log(((draw >> 11) + 1) / (1 << 53)) / weight
        parts.setdefault(d.source, []).append((key, draw - (1 << 64) if draw >> 63 else draw, len(text.encode().split()), d.doc_id))
    sizes = {s: sum(x[2] for x in p) for s, p in parts.items()}
    target = water(sizes, {s: k % 3 + 1 for k, s in enumerate(sorted(sizes))})
    taken = {}
    for s, p in parts.items():
        assert len(p) <= mixing.BUCKET  # then all of a source is one bucket
        epochs = math.floor(target[s] / sizes[s])
        left, order = target[s] - epochs * sizes[s], [(size, i) for _, _, size, i in sorted(p) if size]
        chosen, total = [], 0
        for size, i in order:
            if total + size <= left:
                total += size
                chosen.append(i)
        for _ in range(mixing.SWAPS):
            gap = left - sum(size for size, i in order if i in chosen)
            options = [
                (round(abs(gap - add + drop), 6), a, b, out, into)
                for a, (drop, out) in enumerate([(0, None), *((n, i) for n, i in order if i in chosen)])
                for b, (add, into) in enumerate([(0, None), *((n, i) for n, i in order if i not in chosen)])
            ]
            best = min(options, key=lambda x: x[:3])
            if best[0] >= options[0][0]:
                break
            chosen = [i for i in chosen if i != best[3]] + [best[4]] * (best[4] is not None)
        taken |= {i: epochs + (i in chosen) for _, _, _, i in p}
    return taken


def test_mix(stages):
    docs, made = (rows(x) for x in stages[3])
    want = slow_mix(docs)
    got = {}
    for m in made:
        got[m.doc_id] = got.get(m.doc_id, 0) + 1
    assert got == {i: n for i, n in want.items() if n}
    assert {m for m in made} <= {d for d in docs}


def test_encoding(stages):
    docs, made = stages[4]
    with open(P.path(corpus_pipeline.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((d.doc_id, plain.encode_ordinary(d.text)) for d in docs.collect())
    assert sorted((m.doc_id, m.ids) for m in made.collect()) == want


def test_whole_run(spark, stages):
    got = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == sorted((r.doc_id, r.ids_sha256) for r in stages[4][1].collect())


def test_odd_documents(spark, tmp_path):
    """Null and empty texts, repeated rows, null ids and sources pass every stage."""
    odd = [(1, None, "en", None, 0), (2, "", "en", "a", 0), (3, "Some words here.", "en", "a", 16), (3, "Some words here.", "en", "a", 16), (None, "x y", "en", "b", 3), (4, "w " * 3000, None, "b", 6000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, table in (("documents", odd), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(table, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns[0] == "doc_id"
        out.collect()


LONG = " ".join(f"word{k % 9973} and {k}" for k in range(60_000))  # about 1 MB
PASSAGE = " ".join(f"shared{k}" for k in range(60))
EXTRA = ["k1", "kept", "_kept", "row", "size", "c0", "a.b", "component_id"]


def own(k):
    return " ".join(f"own{k}x{i}" for i in range(60))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, None, "a"), (2, "", "a"), (3, "Some words here.", "a"), (3, "Some words here.", "a"), (None, "x y", "b"), (4, LONG, "b"), (5, LONG + " tail", None),
        (6, f"{own(6)} {PASSAGE}", "é"), (7, f"{PASSAGE} {own(7)}", None),
    ]
    made = spark.createDataFrame([(*r[:2], "en", r[2], len(r[1] or ""), *["clash"] * len(EXTRA)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"e{k} string" for k in range(len(EXTRA))))
    return made.toDF("doc_id", "text", "lang", "source", "n_chars", *EXTRA)


def plain(frame):
    return sorted((r.doc_id or 0, r.text or "") for r in frame.collect())


def test_odd_documents_are_classified_alike(spark, odd, tmp_path):
    spark.createDataFrame([(3, 1), (4, 0), (6, 1), (7, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    made = corpus_pipeline.reject_low_quality(spark, odd, str(tmp_path))
    assert made.columns == odd.columns
    got = plain(made)
    assert set(got) <= set(plain(odd))
    assert ((1, "") in got) == ((2, "") in got) and got.count((3, "Some words here.")) in (0, 2)
    assert corpus_pipeline.reject_low_quality(spark, odd.limit(0), str(tmp_path)).count() == 0


def test_odd_documents_after_near_copies(spark, odd):
    made = corpus_pipeline.drop_near_copies(spark, odd, "")
    assert made.columns == odd.columns
    assert [i for i, _ in plain(made)] == [0, 1, 3, 4, 6, 7]
    assert corpus_pipeline.drop_near_copies(spark, odd.limit(0), "").count() == 0


def test_odd_documents_after_repeats(spark, odd):
    made = corpus_pipeline.remove_repeats(spark, odd, "")
    assert made.columns == odd.columns
    rows = made.collect()
    assert all(r.n_chars == len(r.text) and all(r[k] == "clash" for k in range(5, len(odd.columns))) for r in rows)
    got = plain(made)
    # the shared part of 4 and 5 is all of 4; a repeated row is too short to lose anything; the space beside the passage is no part of it
    assert got == sorted([(1, ""), (2, ""), (3, "Some words here."), (3, "Some words here."), (0, "x y"), (4, ""), (5, " tail"), (6, f"{own(6)} "), (7, f" {own(7)}")])
    assert corpus_pipeline.remove_repeats(spark, odd.limit(0), "").count() == 0


def test_odd_documents_in_the_mix(spark, odd):
    made = corpus_pipeline.mix_sources(spark, odd, "")
    assert made.columns == odd.columns
    got, before = plain(made), plain(odd)
    assert not {(1, ""), (2, "")} & set(got)
    assert all(got.count(r) <= 3 * before.count(r) for r in set(got))
    assert corpus_pipeline.mix_sources(spark, odd.limit(0), "").count() == 0


def test_odd_documents_encoded(spark, odd):
    got = {(r.doc_id or 0, r.decoded_sha256): r.n_tokens for r in corpus_pipeline.encode(spark, odd, "").collect()}
    assert set(got) == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in plain(odd)}
    assert got[1, hashlib.sha256(b"").hexdigest()] == 0
    assert corpus_pipeline.encode(spark, odd.limit(0), "").count() == 0
