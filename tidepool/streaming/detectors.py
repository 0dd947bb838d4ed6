"""Detectors over event streams, in batch and streaming form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.operators.scans import AT, anchored, carried, counting, ordered, previous, where_crowded

WINDOW_MS = 60_000
FAILURES, SEARCHES, MANY_SEARCHES, RUN = 10, 30, 100, 5


def tumbling_counts(events: DataFrame, key: str = "user_id", size_ms: int = WINDOW_MS) -> DataFrame:
    """(key, window_ms, n) of fixed windows; partial counts meet in one shuffle."""
    start = (F.floor(F.col("ms") / size_ms) * size_ms).alias("window_ms")
    return events.groupBy(F.col(key), start).agg(F.count(F.lit(1)).alias("n"))


def anchored_state(times, size_ms: int = WINDOW_MS, start: int | None = None, n: int = 0):
    """Of each time the number of times in its window so far; a window begins with the first time more than its size after the last one's beginning."""
    out = []
    for t in times:
        if start is None or t - start > size_ms:
            start, n = t, 0
        n += 1
        out.append(n)
    return out, start, n


def anchored_counts(events: DataFrame, key: str = "user_id", size_ms: int = WINDOW_MS) -> DataFrame:
    """(key, event_id, ms, n): a running count in windows that begin with a key's first event, and then with the first one after the last window."""
    kind = events.schema[key].dataType.simpleString()

    def plain(rows: DataFrame) -> DataFrame:
        return rows.repartition(F.col(key)).sortWithinPartitions(key, "ms", "event_id").mapInArrow(counting(size_ms, False), f"{key} {kind}, event_id long, ms long, n long")

    def sliced(rows: DataFrame) -> DataFrame:
        told = anchored(ordered(rows, key, ["ms", "event_id"]), key, "ms", size_ms)
        return told.select(key, "event_id", "ms", (F.col(AT) - F.col("_start") + 1).alias("n"))

    own = events.select(key, F.col("event_id").cast("long").alias("event_id"), F.col("ms").cast("long").alias("ms"))
    return where_crowded(own, key, plain, sliced)


def suspicious_searches(counts: DataFrame) -> DataFrame:
    """Running counts with ``level``: none, suspicious from the 30th, high from the 100th."""
    return counts.withColumn("level", F.when(F.col("n") >= MANY_SEARCHES, "high").when(F.col("n") >= SEARCHES, "suspicious").otherwise("none"))


def failure_runs(attempts: DataFrame, key: str = "ip") -> DataFrame:
    """(key, seq, limited): whether an attempt is the 10th failure or a later one in its 60 s window; a success starts anew.

    ``attempts`` is (key, seq, ms, ok). The failures between two successes of a key are a run; windows begin anew in each run.
    """
    kind = attempts.schema[key].dataType.simpleString()

    def plain(rows: DataFrame) -> DataFrame:
        own = rows.repartition(F.col(key)).sortWithinPartitions(key, "ms", "seq").select(key, "seq", "ms", "ok")
        return own.mapInArrow(counting(WINDOW_MS, True), f"{key} {kind}, seq long, ms long, n long").select(key, "seq", (F.col("n") >= FAILURES).alias("limited"))

    def sliced(rows: DataFrame) -> DataFrame:
        rows = carried(ordered(rows, key, ["ms", "seq"]), key, F.when(F.col("ok"), F.col(AT)), "_success")
        failures = rows.where(~F.col("ok")).select(F.struct(F.col(key).alias("key"), F.col("_success").alias("success")).alias("_run"), key, "seq", "ms")
        counted = anchored(ordered(failures, "_run", ["ms", "seq"]), "_run", "ms", WINDOW_MS)
        counted = counted.select(key, "seq", (F.col(AT) - F.col("_start") + 1 >= FAILURES).alias("limited"))
        return counted.unionByName(rows.where("ok").select(key, "seq", F.lit(False).alias("limited")))

    own = attempts.select(key, F.col("seq").cast("long").alias("seq"), F.col("ms").cast("long").alias("ms"), F.coalesce("ok", F.lit(False)).alias("ok"))
    return where_crowded(own, key, plain, sliced)


def increasing_runs(pages: DataFrame, key: str = "session_id", place: str = "seq", offset: str = "offset") -> DataFrame:
    """Rows with ``run``: how many offsets in a row, up to this one, each exceeded the one before; ``flagged`` from 5 on."""

    def plain(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy(key).orderBy(place)
        begins = F.when(F.col(offset) > F.lag(offset).over(order), 0).otherwise(1)
        island = rows.withColumn("_s", begins).withColumn("_g", F.sum("_s").over(order))
        return island.withColumn("run", F.row_number().over(Window.partitionBy(key, "_g").orderBy(place))).drop("_s", "_g")

    def sliced(rows: DataFrame) -> DataFrame:
        told = previous(ordered(rows, key, [place]), key, [offset])
        begins = F.when(F.col(offset) > F.col(f"_previous.{offset}"), None).otherwise(F.col(AT))
        return carried(told, key, begins, "_start").select(*rows.columns, (F.col(AT) - F.col("_start") + 1).cast("int").alias("run"))

    return where_crowded(pages, key, plain, sliced).withColumn("flagged", F.col("run") >= RUN)


def sessions(events: DataFrame, key: str = "user_id", gap_ms: int = 1_800_000) -> DataFrame:
    """(key, start_ms, end_ms, n): runs of events with less than the gap between neighbours. Sessions are counted where their events are; only counts move."""

    def plain(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy(key).orderBy("ms", "event_id")
        new = F.when(F.col("ms") - F.lag("ms").over(order) < gap_ms, 0).otherwise(1)
        return rows.withColumn("_n", new).withColumn("_s", F.sum("_n").over(order)).select(key, "ms", "_s")

    def sliced(rows: DataFrame) -> DataFrame:
        told = previous(ordered(rows, key, ["ms", "event_id"]), key, ["ms"])
        begins = F.when(F.col("ms") - F.col("_previous.ms") < gap_ms, None).otherwise(F.col(AT))
        return carried(told, key, begins, "_s").select(key, "ms", "_s")

    numbered = where_crowded(events.select(key, "ms", "event_id"), key, plain, sliced)
    return numbered.groupBy(key, "_s").agg(F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"), F.count(F.lit(1)).alias("n")).drop("_s")


# ---------------------------------------------------------------- streams


def tumbling_stream(stream: DataFrame, key: str = "user_id", size: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Counts of fixed windows of an event stream (key, ts); events later than the watermark are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), F.col(key)).agg(F.count(F.lit(1)).alias("n")).select(key, "window.start", "n")


def session_stream(stream: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str = "2 minutes") -> DataFrame:
    """Sessions of an event stream, given out once the watermark has passed them."""
    own = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), F.col(key)).agg(F.count(F.lit(1)).alias("n"))
    return own.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def anchored_stream(stream: DataFrame, key: str = "user_id", size_ms: int = WINDOW_MS) -> DataFrame:
    """(key, ms, n) of an event stream (key, ms): the state of a key is the beginning and count of its window."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(own, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(parts)).sort_values("ms")
        counts, start, n = anchored_state(rows["ms"].tolist(), size_ms, start, n)
        state.update((start, n))
        yield pd.DataFrame({key: own[0], "ms": rows["ms"].to_numpy(), "n": counts})

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} long, ms long, n long", "start long, n long", "append", GroupStateTimeout.NoTimeout)


def bounded_stream(spark: SparkSession, folder: str, schema: str, files: int = 64) -> DataFrame:
    """A stream of the Parquet files of a folder, at most ``files`` of them in one batch: what comes faster waits in the folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def ingest_batches(stream: DataFrame, folder: str, checkpoint: str):
    """Records (id, content, ...) of a stream appended to Parquet and to a keyword index, batch by batch; a batch that is run again changes nothing."""
    from tidepool.operators.index import KeywordIndex
    from tidepool.operators.keyword import tokenised

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/memories/batch={number}")
        kept = KeywordIndex(batch.sparkSession, f"{folder}/index", batch.schema["id"].dataType.simpleString())
        kept.append(tokenised(batch).select("id", F.lit(0).alias("kind"), "tokens"), number)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def ingested_index(spark: SparkSession, folder: str, id_type: str = "long"):
    """The keyword index of all that ``ingest_batches`` has appended."""
    from tidepool.operators.index import KeywordIndex

    return KeywordIndex(spark, f"{folder}/index", id_type)
