"""The change feed of entities as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def change_feed(stream: DataFrame, since: int = 0, entity_type: str | None = None, late: str = "10 minutes") -> DataFrame:
    """The changes of a stream of versions (id, entity_type, updated_at, ts, ...) from a time on, each once, however often its files are read again.

    Entities without a type pass every type, as in ``temporal.changes_since``. A change is one id at one time; which were seen is remembered for as long as one can come again before the
    watermark, ``late`` behind the latest ``ts``. What comes later than that is dropped and counted (``late_rows``).
    """
    own = stream.where(F.col("updated_at") >= since)
    if entity_type is not None:
        own = own.where(F.col("entity_type").isNull() | (F.col("entity_type") == entity_type))
    return own.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id", "updated_at"])


def late_rows(query: StreamingQuery) -> int:
    """How many rows of a query came behind its watermark, over the progress that it still reports."""
    return sum(state.numRowsDroppedByWatermark for progress in query.recentProgress for state in progress.stateOperators)
