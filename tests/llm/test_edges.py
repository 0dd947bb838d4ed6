"""Empty tables, null ids, repeated rows, very long texts and clashing columns, for every operator on documents."""

import hashlib
import zlib

import public_tokenizers as P
import pytest

from tidepool.llm import html, mixing, mpeg, quality, queries, repeats, simhash, tokens, toxicity, wordpiece

LONG = " ".join(f"word{k % 9973} and {k}" for k in range(90_000))  # about 1.5 MB
SCHEMA = "doc_id long, text string, source string, copies long, bits long, _len int, kept string"

OPERATORS = {
    "repeats": repeats.removals,
    "mpeg": lambda d: mpeg.media_column(d, keep_media=False),
    "mixing": mixing.mix,
    "tokens": lambda d: tokens.encode_documents(d, P.path(queries.RANKS), P.PATTERN, keep_ids=False),
    "wordpiece": lambda d: wordpiece.count_tokens(d, P.path(queries.WORDS)),
    "simhash": simhash.near_duplicates,
    "quality": lambda d: quality.score(d, quality.fit(d, d.sparkSession.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))),
    "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, d.sparkSession.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))),
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "a"), (2, LONG + "!", "a"), (2, LONG + "!", "a"), (3, None, None), (3, None, None), (None, "", "b"), (None, "x", "b"), (4, "x", "é")]
    return spark.createDataFrame([(*r, 7, 7, 7, "clash") for r in rows], SCHEMA)


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_stay(docs, name):
    got = OPERATORS[name](docs).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 0, 1, 2, 2, 3, 3, 4]
    for own in (2, 3):
        a, b = [tuple(r) for r in got if r.doc_id == own]
        assert a == b


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, name):
    assert OPERATORS[name](docs.where("doc_id = 99")).count() == 0


def test_values_of_long_texts(docs):
    raw = LONG.encode()
    media = {r.doc_id: r for r in OPERATORS["mpeg"](docs).collect()}
    padded = raw + b"\0" * (-len(raw) % 64)
    assert media[1].payload_sha256 == hashlib.sha256(padded).hexdigest()
    assert media[1].tail_crc32 == zlib.crc32(padded[-64:])
    assert {r.doc_id: r.decoded_sha256 for r in OPERATORS["tokens"](docs).collect()}[1] == hashlib.sha256(raw).hexdigest()
    assert {r.doc_id: r.size for r in OPERATORS["mixing"](docs).collect()}[1] == 270_000
    gone = {r.doc_id: r.n_removed for r in OPERATORS["repeats"](docs).collect()}
    assert gone[2] == len(raw) + 1 and gone[1] == len(raw) and gone[3] == 0
    same = {r.doc_id: r.component_id for r in OPERATORS["simhash"](docs).collect()}
    assert same[1] == same[2] == 1 and same[4] == 4


def test_pages(spark):
    body = "<article>" + "<p>one &amp; two</p>" * 50_000 + "</article>"
    rows = [(1, "http://a.example/", body, "c"), (1, "http://a.example/", body, "c"), (None, None, None, "c"), (2, "not a url", "", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, marks string")
    got = html.main_texts(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 50_000 * 11 - 2), (1, 50_000 * 11 - 2), (2, 0)]
    assert html.main_texts(pages.where("page_id = 99")).count() == 0
