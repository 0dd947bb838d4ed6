"""Queries of the detectors, in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.plans import views as V
from tidepool.plans.registry import query
from tidepool.streaming import detectors


@query(f"WITH {V.EVENTS} SELECT user_id, ms // 3600000 * 3600000 AS window_ms, count(*) AS n FROM ev GROUP BY ALL")
def rate_tumbling(spark, sf_dir):
    return detectors.tumbling_counts(V.events(spark, sf_dir), size_ms=3_600_000)


# time is divided by 3600, so that windows of a minute hold several events
_FAST = "fast AS (SELECT user_id, event_id, ms // 3600 AS ms FROM ev)"


def _fast(spark, sf_dir):
    return V.events(spark, sf_dir).select("user_id", "event_id", F.floor(F.col("ms") / 3600).alias("ms"))


@query(
    f"""WITH RECURSIVE {V.EVENTS}, {_FAST}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS i FROM fast),
    w AS (SELECT user_id, event_id, ms, i, ms AS start, CAST(1 AS BIGINT) AS n FROM o WHERE i = 1
        UNION ALL SELECT o.user_id, o.event_id, o.ms, o.i, CASE WHEN o.ms - w.start > 60000 THEN o.ms ELSE w.start END, CASE WHEN o.ms - w.start > 60000 THEN 1 ELSE w.n + 1 END FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)
    SELECT user_id, event_id, ms, n, CASE WHEN n >= 100 THEN 'high' WHEN n >= 30 THEN 'suspicious' ELSE 'none' END AS level FROM w"""
)
def rate_anchored(spark, sf_dir):
    return detectors.suspicious_searches(detectors.anchored_counts(_fast(spark, sf_dir)))


@query(
    f"""WITH {V.EVENTS}, s AS (SELECT user_id AS session_id, ms AS seq, CAST(json_extract(props, '$.k') AS BIGINT) AS "offset" FROM ev),
    a AS (SELECT *, CASE WHEN "offset" > lag("offset") OVER (PARTITION BY session_id ORDER BY seq) THEN 0 ELSE 1 END AS new FROM s),
    g AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY seq) AS island FROM a),
    r AS (SELECT session_id, seq, "offset", row_number() OVER (PARTITION BY session_id, island ORDER BY seq) AS run FROM g)
    SELECT session_id, seq, "offset", CAST(run AS INTEGER) AS run, run >= 5 AS flagged FROM r"""
)
def enumeration_runs(spark, sf_dir):
    own = V.events(spark, sf_dir).select(F.col("user_id").alias("session_id"), F.col("ms").alias("seq"), F.get_json_object("props", "$.k").cast("long").alias("offset"))
    return detectors.increasing_runs(own)


@query(
    f"""WITH {V.EVENTS}, a AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) < 21600000 THEN 0 ELSE 1 END AS new FROM ev),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS s FROM a)
    SELECT user_id, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS n FROM g GROUP BY user_id, s"""
)
def session_windows(spark, sf_dir):
    return detectors.sessions(V.events(spark, sf_dir), gap_ms=21_600_000)


@query(
    f"""WITH RECURSIVE {V.EVENTS}, f AS (SELECT 'ip' || CAST(user_id % 20 AS VARCHAR) AS ip, event_id AS seq, ms // 3600 AS ms, event_type = 'purchase' AS ok FROM ev),
    o AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ms, seq) AS i FROM f),
    w AS (SELECT ip, seq, i, CASE WHEN ok THEN NULL ELSE ms END AS start, CASE WHEN ok THEN 0 ELSE 1 END AS n FROM o WHERE i = 1
        UNION ALL SELECT o.ip, o.seq, o.i, CASE WHEN o.ok THEN NULL WHEN w.start IS NULL OR o.ms - w.start > 60000 THEN o.ms ELSE w.start END,
            CASE WHEN o.ok THEN 0 WHEN w.start IS NULL OR o.ms - w.start > 60000 THEN 1 ELSE w.n + 1 END FROM w JOIN o ON o.ip = w.ip AND o.i = w.i + 1)
    SELECT ip, seq, n >= 10 AS limited FROM w"""
)
def brute_force(spark, sf_dir):
    own = V.events(spark, sf_dir)
    return detectors.failure_runs(
        own.select(F.concat(F.lit("ip"), (F.col("user_id") % 20).cast("string")).alias("ip"), F.col("event_id").alias("seq"), F.floor(F.col("ms") / 3600).alias("ms"), (F.col("event_type") == "purchase").alias("ok"))
    )
