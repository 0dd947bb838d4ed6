"""Table functions against the plain functions that they wrap."""

from pyspark.sql import functions as F

from tidepool.functions import dates, scanners
from tidepool.functions.text import turn_chunks

TEXTS = [None, "", "Launch on 2026-06-10. Beta on January 15, 2026.", "no date", "x" * 500 + "\nUser: May 5\n" + "y" * 900 + "\nAssistant: 2024-02-29 " + "z" * 700]


def test_in_dataframes_and_in_sql(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, content string")
    want_events = sorted((i, k, said, ms) for i, t in enumerate(TEXTS) for k, (said, ms) in enumerate(dates.extract_events(t, 2025)))
    want_turns = sorted((i, k, low, n, t[low : low + n]) for i, t in enumerate(TEXTS) for k, (low, n) in enumerate(turn_chunks(t)))
    assert len(want_events) >= 2 and len(want_turns) >= 3
    events = rows.lateralJoin(scanners.Events(F.col("content").outer(), F.lit(2025))).drop("content")
    turns = rows.lateralJoin(scanners.Turns(F.col("content").outer())).drop("content")
    assert sorted(map(tuple, events.collect())) == want_events
    assert sorted(map(tuple, turns.collect())) == want_turns
    scanners.register(spark)
    rows.createOrReplaceTempView("scanned")
    assert sorted(map(tuple, spark.sql("SELECT id, e.* FROM scanned, LATERAL extract_events(content, 2025) AS e").collect())) == want_events
    assert sorted(map(tuple, spark.sql("SELECT id, t.* FROM scanned, LATERAL turn_passages(content) AS t").collect())) == want_turns
