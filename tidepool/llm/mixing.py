"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a budget of words. A source is first taken whole as often as its budget allows (complete epochs); the rest
of the budget is filled with documents in the order of exponential keys ``-ln(u) / weight``, where ``u`` is a hash of the
document and ``weight`` its quality: a weighted sample without replacement that every run repeats.

The order is never sorted as one. The range of keys in which a source's budget ends is parted into ``PARTS`` equal ranges, the words
of each are summed, and the one range in which the budget ends is parted again, until it holds few documents; only these are put in order. Any
distribution of keys gives small ranges that way, whatever the quality weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from tidepool.llm.bytestext import LOWER, SPACE, filled, flat, runs, slices, small_batches, spans_of
from tidepool.llm.columns import at, kept, numbered, place, taken
from tidepool.llm.scratch import cut

#: Documents that are put in order together, at most; and parts of a range of keys.
BUCKET, PARTS = 1024, 1024
#: Exchanges of documents for a total that is nearer to the budget, at most.
SWAPS = 8
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True

def measured(docs: DataFrame, text: str, id_column: str) -> DataFrame:
    """``docs`` with its words (``size``), a ``quality`` weight in 0.1 to 1, and the hash that ``u`` comes from (``draw``).

    The quality weight grows with the share of letters among the bytes other than white space; an empty text has 0.1.
    """
    chosen = small_batches(docs).select("*", F.xxhash64(F.col(id_column).cast("string"), F.col(text)).alias("draw"))
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, where):
            buffer, offsets = flat(filled(batch.column(where)))
            size, quality = np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, 0.1)
            for i, j in spans_of(offsets):
                part, own = buffer[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                dark = ~SPACE[part]
                size[i:j] = np.diff(np.searchsorted(runs(dark, own[:-1])[0], own))
                shown = np.diff(np.concatenate([[0], np.cumsum(dark)])[own])
                letters = np.diff(np.concatenate([[0], np.cumsum(_LETTER[LOWER[part]])])[own])
                quality[i:j] = 0.1 + 0.9 * letters / np.maximum(shown, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(quality)], names=[*batch.schema.names, "size", "quality"])

    return chosen.mapInArrow(run, StructType([*chosen.schema.fields, StructField("size", LongType()), StructField("quality", DoubleType())]))


def budgets(sizes: DataFrame, source: str = "source", limit: float = 3.0, cycle: int = 3) -> DataFrame:
    """A table (source, size, ...), one row a source, with columns ``weight`` and ``target``.

    Sources by code point, null last, weigh 1 to ``cycle``, repeating. They share the sum of all sizes by weight, none above
    ``limit`` times its size; what is cut off is shared again. A source is full when the rate (budget for each unit of weight)
    is above its level, limit times size over weight; so one pass in the order of levels finds the rate.
    """
    place = Window.orderBy(F.col(source).asc_nulls_last())
    ranked = sizes.withColumn("weight", (F.pmod(F.row_number().over(place) - 1, F.lit(cycle)) + 1).cast("double"))
    ranked = ranked.withColumn("_most", limit * F.col("size")).withColumn("_level", F.col("_most") / F.col("weight"))
    up = Window.orderBy("_level", F.col(source).asc_nulls_last())
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("size").over(everything) - F.coalesce(F.sum("_most").over(before), F.lit(0.0))
    passed = ranked.withColumn("_rate", left / F.sum("weight").over(after)).withColumn("_place", F.row_number().over(up))
    first = F.min(F.when(F.col("_rate") <= F.col("_level"), F.struct("_place", "_rate"))).over(everything)
    target = F.least(F.col("_most"), F.col("weight") * first.getField("_rate"))
    return passed.withColumn("target", F.coalesce(target, F.col("_most"))).drop("_most", "_level", "_rate", "_place")


def ending_ranges(own: DataFrame, plan: DataFrame, most: int = BUCKET, parts: int = PARTS) -> DataFrame:
    """(s, low, high, left): for each source of ``plan`` (s, size, rest, docs) the range of keys in which its ``rest`` ends, both ends included.

    ``left`` is what the documents below the range leave of it. A range holds at most ``most`` documents, or documents of one key.
    """
    held = plan.where("rest > 0").select("s", F.lit(0.0).alias("low"), F.lit(float("inf")).alias("high"), F.col("rest").alias("left"), F.col("docs").alias("n"))
    closed, wide = [], F.col("n") > most
    while True:
        closed.append(held.where(~wide | (F.col("low") >= F.col("high"))).drop("n"))
        held = cut(held.where(wide & (F.col("low") < F.col("high"))), "ranges")
        if held.isEmpty():
            break
        inside = own.join(held, F.col("source").eqNullSafe(F.col("s")) & F.col("key").between(F.col("low"), F.col("high")))
        # keys are below 400: -ln(2^-53) / 0.1 is 367
        share = (F.col("key") - F.col("low")) / (F.least("high", F.lit(400.0)) - F.col("low"))
        sums = inside.groupBy("s", "left", F.least(F.floor(share * parts), F.lit(parts - 1)).alias("part")).agg(
            F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")
        )
        upto = F.sum("words").over(Window.partitionBy("s").orderBy("part"))
        ends = sums.withColumn("upto", upto).where(F.col("upto") > F.col("left")).groupBy("s")
        best = ends.agg(F.min(F.struct("part", "low", "high", (F.col("left") - F.col("upto") + F.col("words")).alias("left"), "n")).alias("end"))
        held = cut(best.select("s", "end.low", "end.high", "end.left", "end.n"), "ranges")
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out


def filled_to(sizes: np.ndarray, left: float, rounds: int = SWAPS) -> np.ndarray:
    """Which documents of a range are taken, from their sizes in key order: those whose prefix sum is within the budget, later ones that still fit, then exchanges for a nearer total.

    An exchange adds a document, drops one, or does both; in each of a few rounds the one that comes nearest to the budget is made, first documents by key winning ties, as long as it comes nearer.
    """
    taken = np.cumsum(sizes) <= left
    rest = left - int(sizes[taken].sum())
    for k in np.flatnonzero(~taken).tolist():
        if sizes[k] <= rest:
            taken[k] = True
            rest -= int(sizes[k])
    for _ in range(rounds):
        gap = left - int(sizes[taken].sum())
        inside, outside = np.flatnonzero(taken), np.flatnonzero(~taken)
        change = np.concatenate([[0], sizes[outside]])[None, :] - np.concatenate([[0], sizes[inside]])[:, None]
        off = np.round(np.abs(gap - change), 6)
        k = int(off.argmin())
        if off.flat[k] >= off[0, 0]:
            break
        drop, add = divmod(k, len(outside) + 1)
        taken[inside[drop - 1 : drop]] = False
        taken[outside[add - 1 : add]] = True
    return taken


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """The documents taken in the range where a budget ends."""
    rows = rows.sort_values(["key", "draw"], kind="stable")
    taken = filled_to(rows["size"].to_numpy(np.int64), float(rows["left"].iloc[0]))
    return rows.loc[taken, ["draw"]].assign(taken=True)[["draw", "taken"]]


def mix(docs: DataFrame, text: str = "text", id_column: str = "doc_id", source: str = "source", limit: float = 3.0, cycle: int = 3, narrow: bool = False) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken`` (words of the document that the mix takes, repeats counted).

    ``taken`` is ``size`` times the number of times the document is in the mix. With ``narrow`` only the id is kept of the
    columns of ``docs``. Null texts and texts without words have size 0 and take nothing; texts of any length are measured whole. Null sources are
    one source, the last. Equal rows (same id and text) are taken or left together. An empty table gives an empty table. Columns of ``docs`` with
    exactly the names above are replaced; all others stay, whatever their names.
    """
    names = ("size", "source_size", "target", "taken")
    old = [id_column] if narrow else [c for c in docs.columns if c not in names]
    if narrow:
        docs = taken(docs, id=id_column, source=source, text=text)
        id_column, source, text = "id", "source", "text"
    columns = kept(docs)[:1] if narrow else [c for c, name in zip(kept(docs), docs.columns, strict=True) if name not in names]
    text, id_column, source = (f"c{place(docs, c)}" for c in (text, id_column, source))
    u = (F.shiftrightunsigned("draw", 11) + 1) / F.lit(float(1 << 53))
    full = measured(numbered(docs), text, id_column).withColumn("key", -F.log(u) / F.col("quality")).withColumn("source", F.col(source))
    own = cut(full.select(id_column, "source", "size", "draw", "key"), "mix")
    sizes = own.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs"))
    epochs = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    plan = budgets(sizes, "source", limit, cycle).select(F.col("source").alias("s"), F.col("size").alias("source_size"), "target", "docs", epochs.alias("epochs"))
    plan = cut(plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "plan")
    ends = cut(ending_ranges(own, plan).withColumnRenamed("s", "e"), "ends")
    here = F.col("source").eqNullSafe(F.col("e"))
    last = own.join(ends, here & F.col("key").between(F.col("low"), F.col("high")) & (F.col("size") > 0))
    units = last.groupBy("e", "draw").agg(F.sum("size").alias("size"), F.first("key").alias("key"), F.first("left").alias("left"))
    filled = units.groupBy("e").applyInPandas(_fill, "draw long, taken boolean").groupBy("draw").agg(F.first("taken").alias("chosen"))
    filled = cut(filled.withColumnRenamed("draw", "filled"), "filled")

    out = (own if narrow else full).join(plan, F.col("source").eqNullSafe(F.col("s"))).join(ends, here, "left")
    within = F.col("key").between(F.col("low"), F.col("high"))
    out = out.join(filled, F.when(within, F.col("draw")) == F.col("filled"), "left")
    more = F.when(F.col("rest") <= 0, False).when(F.col("low").isNull() | (F.col("key") < F.col("low")), True).otherwise(F.coalesce("chosen", F.lit(False)))
    words = out.withColumn("taken", F.col("size") * (F.col("epochs") + more.cast("long")))
    return words.select(*columns, *names).toDF(*old, *names)


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as often as it was taken, with these columns."""
    own = numbered(mixed)
    size, words = at(mixed, "size"), at(mixed, "taken")
    times = F.when(size > 0, (words / size).cast("int")).otherwise(0)
    return own.select(*[at(mixed, c) for c in columns], F.explode(F.array_repeat(F.lit(0), times))).drop("col").toDF(*columns)
