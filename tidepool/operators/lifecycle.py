"""Ageing of records: decay, pruning, consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.constants import DAY_MS, HALF_LIFE_DAYS, PRUNE_AGE_DAYS, PRUNE_BELOW, PRUNE_ROWS
from tidepool.functions.text import column


def decayed(importance: str | Column, last: str | Column, now: int, half_life: float = HALF_LIFE_DAYS) -> Column:
    """Importance halved for each half-life since the last access; as it is without one, or without time passed."""
    own, seen = column(importance).cast("double"), column(last)
    if half_life <= 0:
        return own
    days = (F.lit(now) - seen).cast("double") / DAY_MS
    return F.when((seen > 0) & (F.lit(now) > seen), own * F.pow(F.lit(0.5), days / half_life)).otherwise(own)


def reinforced(importance: str | Column, times: str | Column | int = 1) -> Column:
    """Importance moved a tenth of the way to 1, so many times."""
    n = F.lit(times) if isinstance(times, int) else column(times)
    own = column(importance).cast("double")
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - (1 - own) * F.pow(F.lit(0.9), n)))


def should_prune(importance: str | Column, last: str | Column, now: int, least: float, half_life: float = HALF_LIFE_DAYS) -> Column:
    return decayed(importance, last, now, half_life) < least


def stale(memories: DataFrame, now: int, min_age_days: int = PRUNE_AGE_DAYS, below: float = PRUNE_BELOW, rows: int | None = PRUNE_ROWS) -> DataFrame:
    """Old records of little importance, with ``decayed``; the first ``rows`` by id, or all."""
    found = memories.withColumn("decayed", decayed("importance", "last_accessed", now))
    found = found.where((F.col("created_at") < now - min_age_days * DAY_MS) & (F.col("decayed") < below))
    return found if rows is None else found.orderBy("id").limit(rows)


def candidates(memories: DataFrame, topic: str | None = None) -> DataFrame:
    """Episodic records that are not consolidated yet, of a topic (as written) if one is given."""
    found = memories.where((F.col("tier") == "episodic") & ~F.col("consolidated"))
    return found.where(F.contains("content", F.lit(topic))) if topic else found


def consolidated(memories: DataFrame, topic: str | None = None) -> DataFrame:
    """All records, candidates turned into consolidated semantic ones."""
    hit = (F.col("tier") == "episodic") & ~F.col("consolidated")
    hit = hit & F.contains("content", F.lit(topic)) if topic else hit
    return memories.withColumns({"tier": F.when(hit, "semantic").otherwise(F.col("tier")), "consolidated": F.col("consolidated") | hit})


def merged_entities(entities: DataFrame, referenced: DataFrame) -> DataFrame:
    """(id, canonical_id) of referenced entities of exactly one name, types equal or missing; the lowest id stands for all.

    A missing type goes with the lowest typed entity of its name, or stands with the others without a type.
    """
    own = entities.join(referenced.select("id").distinct(), "id", "left_semi").select("id", "name", "entity_type")
    kinds = own.where(F.col("entity_type").isNotNull()).groupBy("name", "entity_type").agg(F.min("id").alias("first"))
    lowest = kinds.groupBy("name").agg(F.min(F.struct("first", "entity_type")).alias("m")).select("name", F.col("m.entity_type").alias("joined"))
    typed = own.join(lowest, "name", "left").withColumn("kind", F.coalesce("entity_type", "joined", F.lit("")))
    first = typed.groupBy("name", "kind").agg(F.min("id").alias("canonical_id"))
    return typed.join(first, ["name", "kind"]).select("id", "canonical_id")
