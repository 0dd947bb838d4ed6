"""Mentions of names of every kind against the plain rule."""

import re

from tidepool.operators import graph


def test_names_of_every_kind(spark):
    names = ["apple", "New York", "é", "éa", "ait", "o'neil", "a.b", "x\\Ey", "---", "-é-", "日本", "日", "naïve", "AB", "Zoë Smith", "C++", "(x)", "été", "apple", "   "]
    texts = ["An apple a day", "in new york, now", "New  York", "pineapple", "éa aéa éaé xéa", "aité ait aitx", "O'Neil said", "a.b or aXb", "x\\ey", "---", "a---b", "a -é- b", "日本語", "x日本", "日", "the naïve naïveté", "ab abc", "zoë smith zoë", "c++ C++x", "f(x)", "(x)", "été-été", "", None, "a   b"]
    entities = spark.createDataFrame(list(enumerate(names, 1000)), "id long, name string")
    memories = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    want = {
        (i, k)
        for i, n in enumerate(names, 1000)
        for k, t in enumerate(texts)
        if len(n.encode()) >= 3 and re.search("(^|[^A-Za-z0-9])" + re.escape(n.lower()) + "($|[^A-Za-z0-9])", (t or "").lower())
    }
    got = [tuple(r) for r in graph.mentions(entities, memories).collect()]
    assert set(got) == want and len(got) == len(want) > 15


def test_words_of_many_records_move_in_one_row(spark):
    """One row for each word, and pairs come once though an id has two names and a record says a name in two words."""
    texts = spark.range(500).selectExpr("id", "'the naïve naïve日 fox the ' || id % 5 AS content").coalesce(1)
    rows = texts.mapInArrow(graph._said, "w string, ids array<long>").collect()
    assert sorted((r.w, len(r.ids)) for r in rows) == sorted([("the", 500), ("na", 500), ("ve", 500), ("naïve", 500), ("naïve日", 500), ("fox", 500), *[(str(k), 100) for k in range(5)]])
    entities = spark.createDataFrame([(1, "The"), (1, "fox"), (2, "ve日"), (3, "naïve")], "id long, name string")
    got = [tuple(r) for r in graph.mentions(entities, texts).collect()]
    assert len(got) == len(set(got)) == 1500 and {s for s, _ in got} == {1, 2, 3}
