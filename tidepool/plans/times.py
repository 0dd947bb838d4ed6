"""Queries over time: ranges, versions, change feeds, decay."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.functions import dates
from tidepool.operators import lifecycle, tables, temporal
from tidepool.plans import views as V
from tidepool.plans.registry import query

_DAY = 24 * V.HOUR
_SINCE, _UNTIL = V.START + 5 * _DAY, V.START + 20 * _DAY


@query(
    f"WITH {V.MEMORIES}, r AS (SELECT id, tier, created_at, count(*) OVER () > 10 AS truncated FROM memories WHERE created_at BETWEEN {_SINCE} AND {_UNTIL})"
    " SELECT * FROM r ORDER BY created_at DESC, id LIMIT 10"
)
def temporal_search(spark, sf_dir):
    return temporal.search_created(V.memories(spark, sf_dir).select("id", "tier", "created_at"), _SINCE, _UNTIL, 10)


@query(
    f"WITH {V.MEMORIES}, r AS (SELECT id, created_at, count(*) OVER () > 50 AS truncated FROM memories WHERE created_at <= {_UNTIL} + 86399999)"
    " SELECT * FROM r ORDER BY created_at DESC, id LIMIT 50"
)
def temporal_date_only(spark, sf_dir):
    until = temporal.until_ms(_UNTIL, date_only=True)
    return temporal.search_created(V.memories(spark, sf_dir).select("id", "created_at"), 0, until, 50)


@query(f"WITH {V.ENTITIES} SELECT id, name, entity_type, updated_at FROM entities WHERE updated_at >= {_UNTIL} AND (entity_type IS NULL OR entity_type LIKE '%') ORDER BY id LIMIT 50")
def changes_since(spark, sf_dir):
    return temporal.changes_since(V.entities(spark, sf_dir), _UNTIL, 50).select("id", "name", "entity_type", "updated_at")


@query(
    f"""WITH {V.ENTITIES}, m AS (SELECT * FROM entities WHERE event_date > 0 AND event_date >= {_SINCE} AND contains(lower(name), 'bolt') ORDER BY id LIMIT 40)
    SELECT id, event_date, name || ' [date: ' || strftime(make_timestamp(event_date * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z]' || coalesce(list_sum([]), '') || array_to_string(list_transform(observations, lambda o: chr(10) || '  ' || o), '') AS content
    FROM m ORDER BY event_date, id LIMIT 20""".replace(" || coalesce(list_sum([]), '')", "")
)
def search_events(spark, sf_dir):
    found = temporal.search_events(V.entities(spark, sf_dir), _SINCE, 0, 20, "BOLT")
    return found.select("id", "event_date", temporal.event_content("name", dates.shown_iso("event_date"), "observations").alias("content"))


_CURRENT = f"current AS (SELECT user_id AS id, {V.START} - 5000 + user_id AS created_at, max(ms) AS updated_at, round(avg(value), 6) AS value FROM ev GROUP BY user_id)"
_EARLY = V.START + 2 * V.HOUR


def _current(spark, sf_dir):
    own = V.events(spark, sf_dir).groupBy(F.col("user_id").alias("id"))
    return own.agg(F.max("ms").alias("updated_at"), F.round(F.avg("value"), 6).alias("value")).withColumn("created_at", F.lit(V.START - 5000) + F.col("id"))


@query(
    f"""WITH {V.VERSIONS}, {_CURRENT}, l AS (SELECT id, max(valid_from) AS valid_from, arg_max(value, valid_from) AS value FROM versions WHERE valid_from <= {_EARLY} GROUP BY id)
    SELECT * FROM l UNION ALL SELECT id, created_at, value FROM current WHERE created_at <= {_EARLY} AND id NOT IN (SELECT id FROM l)"""
)
def state_at_time(spark, sf_dir):
    return temporal.state_at(V.versions(spark, sf_dir), _current(spark, sf_dir), _EARLY)


# each login as of the purchase before it
@query(
    f"""WITH {V.EVENTS}, p AS (SELECT event_id, user_id AS id, ms AS at FROM ev WHERE event_id % 3 = 0), v AS (SELECT user_id AS id, ms AS valid_from, value FROM ev WHERE event_id % 3 <> 0)
    SELECT p.event_id, p.id, p.at, v.valid_from, v.value FROM p ASOF LEFT JOIN v ON p.id = v.id AND p.at >= v.valid_from"""
)
def state_at_time_set(spark, sf_dir):
    own = V.events(spark, sf_dir)
    probes = own.where("event_id % 3 = 0").select("event_id", F.col("user_id").alias("id"), F.col("ms").alias("at"))
    versions = own.where("event_id % 3 <> 0").select(F.col("user_id").alias("id"), F.col("ms").alias("valid_from"), "value")
    return temporal.as_of(probes, versions)


@query(f"WITH {V.VERSIONS} SELECT id, valid_from, value FROM versions WHERE id = 7 AND valid_from BETWEEN {_SINCE} AND {_UNTIL}")
def history(spark, sf_dir):
    return temporal.history(V.versions(spark, sf_dir), _current(spark, sf_dir), 7, _SINCE, _UNTIL)


@query(f"WITH {V.VERSIONS}, {_CURRENT} SELECT id, updated_at AS valid_from, value FROM current WHERE id = 7 AND created_at <= {V.START - 1}")
def history_fallback(spark, sf_dir):
    return temporal.history(V.versions(spark, sf_dir), _current(spark, sf_dir), 7, 0, V.START - 1)


@query(
    f"""WITH {V.EVENTS}, c AS (SELECT user_id AS id, ms // 600000 * 600000 AS t, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ms // 600000 * 600000, event_id) AS i FROM ev)
    SELECT id, seq, CAST(max(t - i) OVER (PARTITION BY id ORDER BY i) + i AS BIGINT) AS valid_from FROM c"""
)
def version_bump(spark, sf_dir):
    own = V.events(spark, sf_dir).select(F.col("user_id").alias("id"), (F.floor(F.col("ms") / 600_000) * 600_000).alias("valid_from"), F.col("event_id").alias("seq"))
    return temporal.bumped(own).select("id", "seq", "valid_from")


@query(
    f"""WITH {V.VERSIONS}, {_CURRENT}, late AS (SELECT * FROM versions WHERE valid_from > {_EARLY}), f AS (SELECT id, min(valid_from) AS first FROM late GROUP BY id)
    SELECT id, valid_from, value FROM late UNION ALL SELECT c.id, c.created_at, c.value FROM current c LEFT JOIN f USING (id) WHERE first IS NULL OR first > created_at"""
)
def backfill_versions(spark, sf_dir):
    return temporal.backfilled(V.versions(spark, sf_dir).where(F.col("valid_from") > _EARLY), _current(spark, sf_dir))


@query(f"WITH {V.EVENTS} SELECT user_id AS id, ms AS valid_from, ms + event_id % 3000 - 1500 AS updated_at FROM ev WHERE abs(event_id % 3000 - 1500) <= 1000")
def well_keyed_versions(spark, sf_dir):
    own = V.events(spark, sf_dir).select(F.col("user_id").alias("id"), F.col("ms").alias("valid_from"), (F.col("ms") + F.col("event_id") % 3000 - 1500).alias("updated_at"))
    return temporal.well_keyed(own)


@query(
    f"""WITH {V.EVENTS}, v AS (SELECT user_id AS id, ms AS valid_from, CAST(json_extract(props, '$.k') AS BIGINT) AS n_observations FROM ev)
    SELECT id, valid_from, n_observations, n_observations - lag(n_observations, 1, 0) OVER (PARTITION BY id ORDER BY valid_from) AS added FROM v"""
)
def observation_changes(spark, sf_dir):
    own = V.events(spark, sf_dir).select(F.col("user_id").alias("id"), F.col("ms").alias("valid_from"), F.get_json_object("props", "$.k").cast("long").alias("n_observations"))
    return temporal.observation_changes(own)


@query(
    f"""WITH {V.ENTITIES}, d AS (SELECT id, created_at, updated_at, abs(updated_at - created_at) // 86400000 AS days FROM entities)
    SELECT id, days, days + 1 AS inclusive_days, CASE WHEN days >= 7 THEN days // 7 END AS weeks, CASE WHEN days >= 7 THEN days % 7 END AS remaining_days, created_at <= updated_at AS from_is_earlier FROM d"""
)
def durations(spark, sf_dir):
    return V.entities(spark, sf_dir).select("id", *temporal.duration("created_at", "updated_at"))


_DECAYED = f"importance * pow(0.5::DOUBLE, ({V.NOW} - last_accessed) / 86400000.0::DOUBLE / 90)"


@query(f"WITH {V.MEMORIES} SELECT id, round({_DECAYED}, 9) AS decayed FROM memories")
def decay(spark, sf_dir):
    return V.memories(spark, sf_dir).select("id", F.round(lifecycle.decayed("importance", "last_accessed", V.NOW), 9).alias("decayed"))


@query(f"WITH {V.MEMORIES} SELECT id, round(1 - (1 - importance) * pow(0.9::DOUBLE, id % 6), 9) AS importance FROM memories")
def reinforce(spark, sf_dir):
    return V.memories(spark, sf_dir).select("id", F.round(lifecycle.reinforced("importance", F.col("id") % 6), 9).alias("importance"))


@query(f"WITH {V.MEMORIES} SELECT id, {_DECAYED} < 0.01 AS prune FROM memories")
def should_prune(spark, sf_dir):
    return V.memories(spark, sf_dir).select("id", lifecycle.should_prune("importance", "last_accessed", V.NOW, 0.01).alias("prune"))


@query(f"WITH {V.MEMORIES} SELECT id, round({_DECAYED}, 9) AS decayed, substring(content, 1, 200) AS preview FROM memories WHERE created_at < {V.NOW - 340 * 86_400_000} AND {_DECAYED} < 0.02 ORDER BY id LIMIT 200")
def prune_stale(spark, sf_dir):
    found = lifecycle.stale(V.memories(spark, sf_dir), V.NOW, 340, 0.02)
    return found.select("id", F.round("decayed", 9).alias("decayed"), F.substring("content", 1, 200).alias("preview"))


@query(f"WITH {V.MEMORIES} SELECT count(*) AS candidates FROM memories WHERE tier = 'episodic' AND NOT consolidated AND contains(content, 'the')")
def consolidate_dry_run(spark, sf_dir):
    return lifecycle.candidates(V.memories(spark, sf_dir), "the").agg(F.count(F.lit(1)).alias("candidates"))


@query(
    f"""WITH {V.MEMORIES}, c AS (SELECT *, tier = 'episodic' AND NOT consolidated AS hit FROM memories)
    SELECT CASE WHEN hit THEN 'semantic' ELSE tier END AS tier, consolidated OR hit AS consolidated, count(*) AS n FROM c GROUP BY 1, 2"""
)
def consolidate(spark, sf_dir):
    return lifecycle.consolidated(V.memories(spark, sf_dir)).groupBy("tier", "consolidated").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {V.ENTITIES}, o AS (SELECT id, name, CASE WHEN id % 11 = 0 THEN NULL ELSE entity_type END AS entity_type FROM entities WHERE id % 2 = 0),
    k AS (SELECT name, entity_type, min(id) AS first FROM o WHERE entity_type IS NOT NULL GROUP BY ALL), l AS (SELECT name, arg_min(entity_type, first) AS joined FROM k GROUP BY name),
    t AS (SELECT o.id, o.name, coalesce(o.entity_type, l.joined, '') AS kind FROM o LEFT JOIN l USING (name))
    SELECT id, min(id) OVER (PARTITION BY name, kind) AS canonical_id FROM t"""
)
def consolidation_merge(spark, sf_dir):
    own = V.entities(spark, sf_dir).withColumn("entity_type", F.when(F.col("id") % 11 != 0, F.col("entity_type")))
    return lifecycle.merged_entities(own, own.where("id % 2 = 0").select("id"))


# ---------------------------------------------------------------- listing and counting


@query(
    f"WITH {V.MEMORIES}, f AS (SELECT id, source_type, tier, substring(content, 1, 200) AS preview FROM memories) SELECT *, (SELECT count(*) FROM f) AS total_count, (SELECT count(*) FROM f) > 70 AS truncated FROM f ORDER BY id LIMIT 50 OFFSET 20"
)
def list_memories(spark, sf_dir):
    own = V.memories(spark, sf_dir).select("id", "source_type", "tier", F.substring("content", 1, 200).alias("preview"))
    return tables.listed(own, offset=20)


@query(
    f"WITH {V.MEMORIES}, f AS (SELECT id, tier, source_type FROM memories WHERE tier = 'semantic' AND (source_type IS NULL OR source_type = 'src3')) SELECT *, (SELECT count(*) FROM f) AS total_count, (SELECT count(*) FROM f) > 5 AS truncated FROM f ORDER BY id LIMIT 5"
)
def list_filtered(spark, sf_dir):
    return tables.listed(V.memories(spark, sf_dir).select("id", "tier", "source_type"), "src3", "semantic", 0, 5)


@query(f"WITH {V.MEMORIES} SELECT id, tier, content, importance FROM memories WHERE id = 42")
def retrieve_memory(spark, sf_dir):
    return V.memories(spark, sf_dir).where("id = 42").select("id", "tier", "content", "importance")


@query("SELECT 'memories' AS table_name, count(*) AS n FROM documents UNION ALL SELECT 'entities', count(*) FROM part UNION ALL SELECT 'edges', count(*) FROM lineitem UNION ALL SELECT 'vectors', count(*) FROM embeddings")
def stats_counts(spark, sf_dir):
    t = lambda name: V.table(spark, sf_dir, name)
    return tables.counts({"memories": t("documents"), "entities": t("part"), "edges": t("lineitem"), "vectors": t("embeddings")})


@query(f"WITH {V.MEMORIES} SELECT tier, lang, count(*) AS n FROM memories GROUP BY ROLLUP (tier, lang)")
def tier_rollup(spark, sf_dir):
    return V.memories(spark, sf_dir).rollup("tier", "lang").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {V.MEMORIES}, t AS (SELECT id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS t FROM memories), u AS (SELECT unnest(t) AS term FROM t)
    SELECT (SELECT count(*) FROM memories) AS n_docs, (SELECT CAST(sum(len(t)) AS BIGINT) FROM t) AS n_tokens, (SELECT count(DISTINCT term) FROM u) AS n_terms"""
)
def rebuild_index_counts(spark, sf_dir):
    from tidepool.operators.keyword import postings, tokenised

    docs = tokenised(V.memories(spark, sf_dir).select("id", "content")).drop("content")
    index = postings(docs)
    totals = index.agg(F.sum("tf").alias("n_tokens"), F.count_distinct("term").alias("n_terms"))
    return docs.agg(F.count(F.lit(1)).alias("n_docs")).crossJoin(totals)
