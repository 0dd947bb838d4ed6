"""Detectors over event streams whose state is kept per key, with event time, timers and expiry.

Events may come in any order within the watermark's delay. They wait in state until the watermark has passed them and are then stepped
through in order, so the rows given out are those of the batch forms in ``detectors``, whatever files the events came in. A timer of each key wakes it when the
watermark reaches its earliest waiting event, and once more when nothing that can still come depends on what it remembers: then its
state is cleared. The sessions need the RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidepool.streaming.detectors import FAILURES, RUN, WINDOW_MS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: After so long without an event of a key its run of offsets is forgotten: the session has ended.
IDLE_MS = 1_800_000

#: What a key remembers (two numbers, or nothing), an event's time and value, to what it remembers next and the number given out.
Step = Callable[[tuple[int, int] | None, int, int], tuple[tuple[int, int] | None, int]]


def use_rocksdb(spark: SparkSession) -> None:
    """Streams that are started from now on keep their state in RocksDB, which timers and several state variables need."""
    spark.conf.set(PROVIDER, ROCKSDB)


def window_step(size_ms: int = WINDOW_MS) -> Step:
    """(beginning, count) of a window that begins with the first event after the last one's end; gives the count out."""

    def step(held, ms, _):
        start, n = held if held and ms - held[0] <= size_ms else (ms, 0)
        return (start, n + 1), n + 1

    return step


def failure_step(size_ms: int = WINDOW_MS) -> Step:
    """As ``window_step`` for failures (value 0); a success (1) forgets the window and gives out 0."""
    count = window_step(size_ms)
    return lambda held, ms, ok: (None, 0) if ok else count(held, ms, ok)


def run_step(held, _, offset):
    """(last offset, length of the run of increasing offsets); gives the length out."""
    n = held[1] + 1 if held and offset > held[0] else 1
    return (offset, n), n


class InOrder(StatefulProcessor):
    """Steps through the events (ms, seq, value) of each key in order, once the watermark has passed them."""

    def __init__(self, key: str, step: Step, forget_ms: int, by_last: bool):
        """A key's memory ends ``forget_ms`` after its last event (``by_last``), or after the number that it remembers first, a time."""
        self.key, self.step, self.forget_ms, self.by_last = key, step, forget_ms, by_last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, seq long, value long")
        self.memory = handle.getValueState("memory", "a long, b long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for part in rows:
            events = list(zip(part["ms"].tolist(), part["seq"].tolist(), part["value"].tolist(), strict=True))
            if events:
                self.waiting.appendList(events)
                first = min(e[0] for e in events) if first is None else min(first, min(e[0] for e in events))
        if first is not None:
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        events = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [e for e in events if e[0] <= passed]
        kept = self.memory.get() if self.memory.exists() else None
        held, last = (None, None) if kept is None else ((kept[0], kept[1]), kept[2])
        out = []
        for ms, seq, value in due:
            held, given = self.step(held, ms, value)
            last = ms
            out.append((ms, seq, given))
        self.waiting.clear()
        if due != events:
            self.waiting.put([tuple(e) for e in events[len(due) :]])
            self.handle.registerTimer(events[len(due)][0])
        ends = None if held is None else (last if self.by_last else held[0]) + self.forget_ms + 1
        if ends is None or ends <= passed:
            self.memory.clear()
        else:
            self.memory.update((*held, last))
            self.handle.registerTimer(ends)
        if out:
            yield pd.DataFrame({self.key: [key[0]] * len(out), "ms": [x[0] for x in out], "seq": [x[1] for x in out], "n": [x[2] for x in out]})

    def close(self) -> None:
        pass


def _stepped(events: DataFrame, key: str, step: Step, forget_ms: int, by_last: bool, delay: str) -> DataFrame:
    kind = events.schema[key].dataType.simpleString()
    own = events.withWatermark("ts", delay)
    own = own.select(key, F.unix_millis("ts").alias("ms"), "seq", "value", "ts")
    return own.groupBy(key).transformWithStateInPandas(InOrder(key, step, forget_ms, by_last), f"{key} {kind}, ms long, seq long, n long", "append", "eventTime")


def _events(stream: DataFrame, key: str, seq: str, value: Column) -> DataFrame:
    return stream.select(key, "ts", F.col(seq).cast("long").alias("seq"), value.cast("long").alias("value"))


def search_rates(stream: DataFrame, key: str = "user_id", seq: str = "event_id", size_ms: int = WINDOW_MS, delay: str = "2 minutes") -> DataFrame:
    """(key, ms, seq, n) of a stream (key, ts, seq): the running count in windows that begin with a key's first event, as ``detectors.anchored_counts``.

    Events later than the watermark (``delay`` behind the latest one seen) are dropped and counted by Spark. A window is forgotten once the watermark is past its end.
    """
    return _stepped(_events(stream, key, seq, F.lit(0)), key, window_step(size_ms), size_ms, False, delay)


def limited_attempts(stream: DataFrame, key: str = "ip", seq: str = "seq", size_ms: int = WINDOW_MS, delay: str = "2 minutes") -> DataFrame:
    """(key, ms, seq, limited) of a stream (key, ts, seq, ok), as ``detectors.failure_runs``."""
    counted = _stepped(_events(stream, key, seq, F.col("ok")), key, failure_step(size_ms), size_ms, False, delay)
    return counted.select(key, "ms", "seq", (F.col("n") >= FAILURES).alias("limited"))


def page_runs(stream: DataFrame, key: str = "session_id", seq: str = "seq", offset: str = "offset", idle_ms: int = IDLE_MS, delay: str = "2 minutes") -> DataFrame:
    """(key, ms, seq, run, flagged) of a stream (key, ts, seq, offset), as ``detectors.increasing_runs`` in order of time.

    A key's run is forgotten when the watermark is ``idle_ms`` past its last event.
    """
    counted = _stepped(_events(stream, key, seq, F.col(offset)), key, run_step, idle_ms, True, delay)
    return counted.select(key, "ms", "seq", F.col("n").cast("int").alias("run"), (F.col("n") >= RUN).alias("flagged"))
