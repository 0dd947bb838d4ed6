"""Segmented scans: running values of each key in order, with no key in one task.

Rows are parted by ranges of key and order into slices, so a key with many rows spans several slices one after another. Within a slice a value
is carried forward by a window over slice and key. Each slice is reduced to the last value of each of its keys; the last values
of earlier slices are carried into later ones, and joined to the rows of the one key that a slice takes over from the slices before it.
So the table that is carried has no more rows than there are slices.

Slices cost passes over the rows, so only keys with more than ``CROWD`` rows are scanned by them (``where_crowded``); others are one task's, in order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.operators.lineage import written

#: Bytes of a slice, about, by what Spark knows of the input's size; sizes from here on mean that Spark knows none.
SLICE_BYTES, MOST_SLICES, UNKNOWN = 64 << 20, 50_000, 1 << 60
SLICE, AT = "_slice", "_at"
#: Rows of a key from which on it is scanned in slices.
CROWD = 1 << 20


def slice_count(rows: DataFrame) -> int:
    """As many slices as shuffles have partitions, and enough that none is far above ``SLICE_BYTES``."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, min(math.ceil(size / SLICE_BYTES), MOST_SLICES)) if size < UNKNOWN else least


def ordered(rows: DataFrame, key: str, order: list[str], slices: int | None = None) -> DataFrame:
    """``rows``, written, with ``_slice`` and ``_at``: consecutive numbers by key and then order, over all keys."""
    dealt = rows.repartitionByRange(slices or slice_count(rows), key, *order).sortWithinPartitions(key, *order)
    dealt = written(dealt.withColumn("_id", F.monotonically_increasing_id()), "slices")
    place = F.shiftright("_id", 33)
    sizes = dealt.groupBy(place.alias(SLICE)).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)  # one row for each slice
    sizes = written(sizes.select(SLICE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "sizes")
    numbered = dealt.withColumn(SLICE, place).join(F.broadcast(sizes), SLICE)
    return numbered.withColumn(AT, F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_before")


def where_crowded(rows: DataFrame, key: str, plain: Callable[[DataFrame], DataFrame], sliced: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of keys with more than ``CROWD`` rows by ``sliced``, all others by ``plain``; both give the same columns."""
    crowded = rows.groupBy(F.col(key).alias("_crowded")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWD).select("_crowded")
    if crowded.isEmpty():
        return plain(rows)
    crowded = written(crowded, "crowded")
    same = F.col(key).eqNullSafe(F.col("_crowded"))
    return plain(rows.join(crowded, same, "left_anti")).unionByName(sliced(rows.join(crowded, same, "left_semi")))


def carried(rows: DataFrame, key: str, value: Column, name: str, earlier: bool = False) -> DataFrame:
    """``rows`` of ``ordered`` with the last value of the same key that isn't null, up to each row; with ``earlier``, before it."""
    own = Window.partitionBy(SLICE, key).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1 if earlier else 0)
    ends = rows.select(SLICE, F.col(key).alias("_key"), AT, value.alias("_value"))
    ends = ends.groupBy(SLICE, "_key").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(AT))).alias("_value"))
    before = Window.partitionBy("_key").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    taken = ends.select(F.col(SLICE).alias("_into"), "_key", F.last("_value", ignorenulls=True).over(before).alias("_before")).where(F.col("_before").isNotNull())
    taken = written(taken, "carried")
    with_own = rows.withColumn("_own", F.last(value, ignorenulls=True).over(own))
    both = with_own.join(taken, (F.col(SLICE) == F.col("_into")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return both.withColumn(name, F.coalesce("_own", "_before")).drop("_own", "_into", "_key", "_before")


def previous(rows: DataFrame, key: str, columns: list[str], name: str = "_previous") -> DataFrame:
    """``rows`` of ``ordered`` with a struct of the columns of the row before, of the same key; null in its first row."""
    return carried(rows, key, F.struct(*columns), name, earlier=True)


def anchored(rows: DataFrame, key: str, time: str, size: int, name: str = "_start") -> DataFrame:
    """``rows`` of ``ordered`` by (key, time, ...) with the ``_at`` of the row that began their window.

    A window begins with a key's first row, and with the first row more than ``size`` after the last window's beginning. Each row points to the first
    row beyond a window that would begin with it. A row more than ``size`` after the row before it begins a window whatever came before. From those, the rows that
    are reached over the pointers begin the other windows; pointers are doubled in each round, so there are as many rounds as the number of
    windows between two such rows has binary digits.
    """
    rows = written(rows, "rows")
    last = F.struct(F.col(time), F.col(AT))
    probes = rows.select(key, (F.col(time) + size).alias("_t"), F.lit(1).alias("_probe"), F.col(AT).alias("_asked"), F.lit(None).cast("long").alias("_mark"))
    marks = rows.select(key, F.col(time).alias("_t"), F.lit(0).alias("_probe"), F.lit(None).cast("long").alias("_asked"), F.col(AT).alias("_mark"))
    both = ordered(probes.unionByName(marks), key, ["_t", "_probe", "_asked", "_mark"])
    within = carried(both, key, F.col("_mark"), "_last").where("_probe = 1").select(F.col("_asked").alias(AT), "_last")
    told = previous(rows, key, [time]).join(within, AT)
    sure = F.col("_previous").isNull() | (F.col(time) - F.col(f"_previous.{time}") > size)
    told = written(carried(told.withColumn("_sure", sure).drop("_previous"), key, F.when(F.col("_sure"), F.struct(F.col(AT).alias("at"), F.col("_last").alias("last"))), "_first"), "told")
    beyond = told.where(F.col(AT) > F.col("_first.last"))
    found = begun = written(beyond.select((F.col("_first.last") + 1).alias("_a")).distinct(), "begun")
    # any other pointer leads to a row that begins a window whatever came before
    pointers = beyond.select(F.col(AT).alias("_a"), (F.col("_last") + 1).alias("_b")).join(beyond.select(F.col(AT).alias("_b")), "_b", "left_semi")
    pointers = written(pointers.select("_a", "_b"), "pointers")
    while not begun.isEmpty():
        fresh = found.join(pointers, "_a").select(F.col("_b").alias("_a")).distinct()
        begun = written(fresh.join(found, "_a", "left_anti"), "begun")
        found = written(found.unionByName(begun), "found")
        onward = pointers.select(F.col("_a").alias("_b"), F.col("_b").alias("_c"))
        pointers = written(pointers.join(onward, "_b").select("_a", F.col("_c").alias("_b")), "pointers")
    starts = told.join(found.withColumnRenamed("_a", "_begun"), F.col(AT) == F.col("_begun"), "left")
    begins = F.when(F.col("_sure") | F.col("_begun").isNotNull(), F.col(AT))
    return carried(starts.drop("_last", "_first"), key, begins, name).drop("_sure", "_begun")


def window_counts(groups: np.ndarray, times: np.ndarray, size: int, start: int | None = None, n: int = 0) -> tuple[np.ndarray, int, int]:
    """Running counts of rows in order of group and time, in windows that begin as in ``anchored``; then the beginning and count of the last window.

    ``groups`` are numbers that rise. ``start`` and ``n`` are the open window that the first group's rows find. Which rows begin windows is found for all groups together, over pointers that are doubled.
    """
    many = len(times)
    span = int(times.max()) - int(times.min()) + size + 2
    place = (groups - groups[0]) * span + (times - times.min())
    pointer = np.append(np.searchsorted(place, place + size, "right"), many)
    begins = np.zeros(many + 1, bool)
    begins[np.flatnonzero(groups[1:] != groups[:-1]) + 1] = True
    begins[0 if start is None else int(np.searchsorted(place, start + size - int(times.min()), "right"))] = True
    while pointer[:many].min() < many:
        begins[pointer[begins]] = True
        pointer = pointer[pointer]
    rows = np.arange(many)
    first = np.maximum.accumulate(np.where(begins[:many], rows, -1))
    counts = np.where(first < 0, rows + 1 + n, rows - first + 1)
    return counts, start if first[-1] < 0 else int(times[first[-1]]), int(counts[-1])


def counting(size: int, resets: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows (key, id, time) in order of key and time: (key, id, time, n) by ``window_counts``, batch by batch.

    With ``resets`` rows are (key, id, time, reset): where reset is true the count is 0 and the next row begins a window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, start, n = None, None, 0
        for batch in batches:
            if not len(batch):
                continue
            keys = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            times = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            reset = batch.column(3).to_numpy(zero_copy_only=False).astype(bool) if resets else np.zeros(len(batch), bool)
            new = np.zeros(len(batch), np.int64)
            new[1:] = (keys[1:] != keys[:-1]) | reset[1:] | reset[:-1]
            goes_on = last is not None and last[0] == batch.column(0)[0].as_py() and start is not None and not reset[0]
            counts, start, n = window_counts(np.cumsum(new), times, size, start if goes_on else None, n if goes_on else 0)
            start = None if reset[-1] else start
            last = (batch.column(0)[-1].as_py(),)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.where(reset, 0, counts))], names=[*batch.schema.names[:3], "n"])

    return run
