"""Extra columns whose names differ from the operators' own only in case, repeat theirs, or hold dots."""

import pytest

from tests.llm.test_edges import OPERATORS
from tidepool.llm import closecopies, html, mixing, quality, repeats

NAMES = ["doc_id", "text", "source", "DOC_ID", "Text", "id", "node", "row", "k1", "k2", "kept", "own0", "c0", "c1", "_kept", "_k1", "_s", "_e", "key", "draw", "quality", "low", "rest", "a.b", "n_chars", "bits", "component_id", "label"]
LONG = " ".join(f"w{k}" for k in range(200))
ROWS = [(1, LONG, "a"), (2, LONG, "a"), (3, None, None), (None, "x y", "b"), (4, "Another text, and more of it.", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame([(*r, *["clash"] * (len(NAMES) - 3)) for r in ROWS], "c0 long, c1 string, c2 string, " + ", ".join(f"c{k} string" for k in range(3, len(NAMES))))
    return plain.toDF(*NAMES)


@pytest.mark.parametrize("name", sorted(set(OPERATORS) - {"mixing", "quality"}))
def test_operators_take_their_own_columns(docs, name):
    got = OPERATORS[name](docs).collect()
    assert sorted(r[0] or 0 for r in got) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("made", ["mix", "score", "repeats", "copies", "good"])
def test_columns_stay(spark, docs, made):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id long, quality int, DOC_ID int")
    frame, ids = {
        "mix": lambda: (mixing.mix(docs), 5),
        "score": lambda: (quality.score(docs, quality.fit(docs, labels)), 5),
        "repeats": lambda: (repeats.deduplicated(docs), 5),
        "copies": lambda: (closecopies.first_of_each(docs), 4),
        "good": lambda: (quality.keep_good(docs, labels, threshold=0.0), 5),
    }[made]()
    assert frame.columns[: len(NAMES)] == NAMES
    got = frame.collect()
    assert len(got) == ids
    for r in got:
        assert all(r[k] == "clash" for k in range(3, len(NAMES)) if NAMES[k] not in ("n_chars",))


def test_pages(spark):
    plain = spark.createDataFrame([(1, "http://a.example/", "<p>one</p>", "x", "y", "z")], "a long, b string, c string, d string, e string, f string")
    got = html.main_texts(plain.toDF("page_id", "url", "html", "HTML", "host", "a.b")).collect()
    assert [(r.page_id, r.text) for r in got] == [(1, "one")]


def test_repeated_rows_of_the_mix(docs):
    mixed = mixing.mix(docs)
    assert mixing.repeated(mixed, NAMES[:3]).columns == NAMES[:3]
