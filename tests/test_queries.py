"""Every registered query against DuckDB over the same tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, Decimal):
        return round(float(x), 6)
    if isinstance(x, (list, tuple)):
        return tuple(cell(y) for y in x)
    return x


def ordered(rows, names):
    place = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(cell(r[k]) for k in place) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    frame = entry.queries()[name](spark, SMALL)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(names)
    want = ordered(cursor.fetchall(), names)
    got = ordered([tuple(r) for r in frame.collect()], frame.columns)
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", ["extract_events", "knn_index_recall"])
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, SMALL).count() > 0


def test_every_query_has_sql_or_is_known():
    core = {n for n in entry.registry.QUERIES if n not in SQL}
    assert core == {"extract_events", "knn_index_recall"}


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
