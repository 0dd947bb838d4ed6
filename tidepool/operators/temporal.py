"""Time travel over versions, change feeds, and events. All times are milliseconds since 1970; 0 or null is unset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.functions.constants import DAY_MS, END_OF_DAY_MS
from tidepool.functions.text import column
from tidepool.operators.scans import carried, ordered, where_crowded


def within(c: str | Column, since: int = 0, until: int = 0) -> Column:
    """Inclusive bounds, of which 0 is none."""
    own, out = column(c), F.lit(True)
    out = out & (own >= since) if since else out
    return out & (own <= until) if until else out


def until_ms(ms: int, date_only: bool) -> int:
    """An upper bound; one given as a date alone holds to the end of that day."""
    return ms + END_OF_DAY_MS if date_only and ms else ms


def search_created(memories: DataFrame, since: int, until: int, k: int) -> DataFrame:
    """The latest k records of a range, with ``truncated``: whether there were more."""
    found = memories.where(within("created_at", since, until)).orderBy(F.desc("created_at"), "id").limit(k + 1)
    place = Window.orderBy(F.desc("created_at"), "id")
    more = F.count(F.lit(1)).over(Window.partitionBy()) > k
    return found.withColumn("truncated", more).withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k).drop("_n")


def changes_since(entities: DataFrame, since: int, k: int, entity_type: str | None = None) -> DataFrame:
    """The first k changed entities in id order; entities without a type pass every type."""
    changed = entities.where(F.col("updated_at") >= since)
    if entity_type is not None:
        changed = changed.where(F.col("entity_type").isNull() | (F.col("entity_type") == entity_type))
    return changed.orderBy("id").limit(k)


def search_events(entities: DataFrame, since: int, until: int, k: int, name: str | None = None) -> DataFrame:
    """Dated entities by date. Only the first 2k matches in id order are looked at; a null name passes every name."""
    dated = entities.where((F.col("event_date") > 0) & within("event_date", since, until))
    if name:
        dated = dated.where(F.col("name").isNull() | F.contains(F.lower("name"), F.lit(name.lower())))
    return dated.orderBy("id").limit(2 * k).orderBy("event_date", "id").limit(k)


def event_content(name: str | Column, iso: str | Column, observations: str | Column) -> Column:
    lines = F.transform(F.coalesce(column(observations), F.array().cast("array<string>")), lambda o: F.concat(F.lit("\n  "), o))
    return F.concat(column(name), F.lit(" [date: "), column(iso), F.lit("]"), F.array_join(lines, ""))


def state_at(versions: DataFrame, current: DataFrame, at: int) -> DataFrame:
    """(id, valid_from, value): of each entity its last version up to a time, else its current state if it existed by then.

    ``versions`` is (id, valid_from, value), ``current`` (id, created_at, value). The last version is an aggregate, so no version list is gathered.
    """
    before = versions.where(F.col("valid_from") <= at) if at else versions
    last = before.groupBy("id").agg(F.max(F.struct("valid_from", "value")).alias("v")).select("id", "v.valid_from", "v.value")
    rest = current.where((F.col("created_at") <= at) | F.lit(not at)).join(last.select("id"), "id", "left_anti")
    return last.unionByName(rest.select("id", F.col("created_at").alias("valid_from"), "value"))


def as_of(probes: DataFrame, versions: DataFrame, key: str = "id", at: str = "at", valid_from: str = "valid_from") -> DataFrame:
    """Each probe with the last version of its key up to its time; probes without one have nulls.

    Probes and versions are ordered together and the last version is carried forward, so the join costs one sort, not
    probes times versions; a key with very many of them spans several slices. A version at the probe's own time counts.
    """
    values = [c for c in versions.columns if c != key]
    left = probes.select(F.col(key), F.col(at).alias("_t"), F.lit(1).alias("_probe"), F.struct(*probes.columns).alias("_p"), F.lit(None).cast(versions.select(F.struct(*values)).schema[0].dataType).alias("_v"))
    right = versions.select(F.col(key), F.col(valid_from).alias("_t"), F.lit(0).alias("_probe"), F.lit(None).cast(left.schema["_p"].dataType).alias("_p"), F.struct(*values).alias("_v"))
    # times without a value stand first, so a probe without a time finds none; what has no unique order is parted by a hash
    both = left.unionByName(right).where((F.col("_probe") == 1) | F.col("_t").isNotNull()).withColumn("_tie", F.xxhash64(*[F.col(f"_p.{c}") for c in probes.columns]))
    order = Window.partitionBy(key).orderBy("_t", "_probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = lambda rows: rows.withColumn("_found", F.last("_v", ignorenulls=True).over(order)).select("_probe", "_p", "_found")
    sliced = lambda rows: carried(ordered(rows, key, ["_t", "_probe", "_tie"]), key, F.col("_v"), "_found").select("_probe", "_p", "_found")
    told = where_crowded(both, key, plain, sliced).where("_probe = 1")
    return told.select("_p.*", *[F.col(f"_found.{c}").alias(c if c not in probes.columns else f"version_{c}") for c in values])


def history(versions: DataFrame, current: DataFrame, entity, since: int = 0, until: int = 0) -> DataFrame:
    """An entity's versions in a range, oldest first; without any its current state if that falls in the range."""
    own = versions.where((F.col("id") == entity) & within("valid_from", since, until)).select("id", "valid_from", "value")
    now = current.where(F.col("id") == entity)
    now = now.where(F.col("updated_at") >= since) if since else now
    now = now.where(F.col("created_at") <= until) if until else now
    rest = now.join(own.select("id").distinct(), "id", "left_anti").select("id", F.col("updated_at").alias("valid_from"), "value")
    return own.unionByName(rest).orderBy("valid_from")


def bumped(versions: DataFrame) -> DataFrame:
    """Versions with distinct times: one that collides with those before it is moved on by milliseconds.

    ``t'(i) = max(t(i), t'(i-1) + 1)`` is a running maximum of ``t(i) - i``, plus ``i``. A key's versions are one group here: an entity has as many as it was changed.
    """
    order = Window.partitionBy("id").orderBy("valid_from", "seq")
    numbered = versions.withColumn("_i", F.row_number().over(order).cast("long"))
    return numbered.withColumn("valid_from", F.max(F.col("valid_from") - F.col("_i")).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_i")).drop("_i")


def backfilled(versions: DataFrame, current: DataFrame) -> DataFrame:
    """Versions with a first one at the creation of each entity that has none by then; running it again adds nothing."""
    first = versions.groupBy("id").agg(F.min("valid_from").alias("first"))
    lacking = current.join(first, "id", "left").where(F.col("first").isNull() | (F.col("first") > F.col("created_at")))
    return versions.unionByName(lacking.select("id", F.col("created_at").alias("valid_from"), "value"))


def well_keyed(versions: DataFrame, tolerance: int = 1000) -> DataFrame:
    """Versions whose key is within the tolerance of the update they hold."""
    return versions.where(F.abs(F.col("valid_from") - F.col("updated_at")) <= tolerance)


def observation_changes(versions: DataFrame) -> DataFrame:
    """Versions with ``added``: observations more than in the version before."""
    order = Window.partitionBy("id").orderBy("valid_from")
    return versions.withColumn("added", F.col("n_observations") - F.lag("n_observations", 1, 0).over(order))


def duration(start: str | Column, end: str | Column) -> list[Column]:
    """days, inclusive_days, weeks and remaining_days (null below 7 days), from_is_earlier."""
    a, b = column(start), column(end)
    days = F.floor(F.abs(b - a) / DAY_MS)
    long = days >= 7
    return [
        days.alias("days"), (days + 1).alias("inclusive_days"), F.when(long, F.floor(days / 7)).alias("weeks"),
        F.when(long, days % 7).alias("remaining_days"), (a <= b).alias("from_is_earlier"),
    ]
