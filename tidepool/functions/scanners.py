"""Scanners as table functions: each text gives rows, joined to its own row by a lateral join, in DataFrames and in SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidepool.functions import dates
from tidepool.functions.text import turn_chunks


@F.udtf(returnType="n int, description string, event_date long")
class Events:
    """The dates that a text mentions, in its order, with the sentence around each; ``year`` is that of dates without one. A null text has none."""

    def eval(self, text: str, year: int) -> Iterator[tuple[int, str, int]]:
        for k, (said, ms) in enumerate(dates.extract_events(text, year)):
            yield k, said, ms


@F.udtf(returnType="sequence int, char_offset int, char_length int, chunk string")
class Turns:
    """The passages of a conversation, cut before a speaker's turn; none of a null text or of one that is a single passage."""

    def eval(self, text: str) -> Iterator[tuple[int, int, int, str]]:
        for k, (low, n) in enumerate(turn_chunks(text)):
            yield k, low, n, text[low : low + n]


def register(spark: SparkSession) -> None:
    """Both under the names ``extract_events`` and ``turn_passages`` for SQL: ``FROM t, LATERAL extract_events(t.content, 2025)``."""
    spark.udtf.register("extract_events", Events)
    spark.udtf.register("turn_passages", Turns)
