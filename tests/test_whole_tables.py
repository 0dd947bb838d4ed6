"""Queries that have to look at every row of a table."""

import re

import __spark_entry__ as entry
import pytest


@pytest.fixture
def folder(spark, tmp_path):
    texts = ["See apple key sk-" + "a1" * 16 + " end", "an Orange, apple", "no banana; orange-apple", "the apple", "pineapple orange", "x été", "Password=hunter2hunter2 ÉTÉ", None]
    spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts, 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), dict(enumerate(texts, 1))


def test_secrets_of_documents_are_redacted(spark, folder):
    path, texts = folder
    got = {r.id: r.content for r in entry.queries()["redact_documents"](spark, path).collect()}
    assert {i + 100 for i in texts} < set(got)
    assert got[101] == "See apple key [secret] end" and got[107] == "[secret]unter2 ÉTÉ" and got[108] is None


def test_names_of_all_documents_are_linked(spark, folder):
    path, texts = folder
    names = {}
    for i, t in texts.items():
        words = re.findall(r"[^\W_]+", t or "")
        if len(words) > 1:
            names.setdefault(words[1], i + 1_000_000)
    want = set()
    for name, source in names.items():
        for i, t in texts.items():
            if len(name.encode()) >= 3 and i % 5 and re.search("(^|[^A-Za-z0-9])" + re.escape(name.lower()) + "($|[^A-Za-z0-9])", (t or "").lower()):
                want.add((source, i))
    got = {(r.source_id, r.target_id) for r in entry.queries()["link_entities"](spark, path).collect()}
    assert want and got == want
