"""The model's tables as views of the given ones, in Spark and in SQL.

Records come from ``documents``, entities from ``part``, edges from ``lineitem`` and the nation tables, versions from ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Midnight of 2024-01-01, and the fixed present of all queries.
START, NOW = 1_704_067_200_000, 1_735_689_600_000
HOUR, MINUTE = 3_600_000, 60_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("doc_id") % 3 == 0, "episodic").when(F.col("doc_id") % 3 == 1, "semantic").otherwise("procedural")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("content"),
        F.col("source").alias("source_type"),
        "lang",
        tier.alias("tier"),
        ((F.col("doc_id") * 37 % 100).cast("double") / 100).alias("importance"),
        (F.lit(START) + F.col("doc_id") % 1000 * HOUR).alias("created_at"),
        (F.lit(START) + F.col("doc_id") % 1000 * HOUR + F.col("doc_id") % 7 * 24 * HOUR).alias("last_accessed"),
        (F.col("doc_id") % 5 == 0).alias("consolidated"),
    )


MEMORIES = f"""memories AS (
    SELECT doc_id AS id, text AS content, source AS source_type, lang,
           CASE doc_id % 3 WHEN 0 THEN 'episodic' WHEN 1 THEN 'semantic' ELSE 'procedural' END AS tier,
           CAST(doc_id * 37 % 100 AS DOUBLE) / 100 AS importance,
           {START} + doc_id % 1000 * {HOUR} AS created_at,
           {START} + doc_id % 1000 * {HOUR} + doc_id % 7 * 24 * {HOUR} AS last_accessed,
           doc_id % 5 = 0 AS consolidated
    FROM documents)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    observations = F.array(F.col("p_brand"), F.concat(F.lit("size "), F.col("p_size").cast("string")), F.concat(F.lit("size "), (F.col("p_size") % 3).cast("string")))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("entity_type"),
        F.slice(observations, 1, (F.col("p_partkey") % 3 + 1).cast("int")).alias("observations"),
        (F.lit(START) + F.col("p_partkey") % 5000 * MINUTE).alias("created_at"),
        (F.lit(START) + F.col("p_partkey") * 7919 % 100000 * MINUTE).alias("updated_at"),
        F.when(F.col("p_partkey") % 4 == 0, F.lit(START) + F.col("p_size").cast("long") * 24 * HOUR).otherwise(0).alias("event_date"),
    )


ENTITIES = f"""entities AS (
    SELECT p_partkey AS id, p_name AS name, p_type AS entity_type,
           [p_brand, 'size ' || CAST(p_size AS VARCHAR), 'size ' || CAST(p_size % 3 AS VARCHAR)][1:(p_partkey % 3 + 1)] AS observations,
           {START} + p_partkey % 5000 * {MINUTE} AS created_at,
           {START} + p_partkey * 7919 % 100000 * {MINUTE} AS updated_at,
           CASE WHEN p_partkey % 4 = 0 THEN {START} + CAST(p_size AS BIGINT) * 24 * {HOUR} ELSE 0 END AS event_date
    FROM part)"""


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts to parts, suppliers (ids from 10 million) and customers (from 20 million): some are no entities."""
    kind = F.when(F.col("l_linenumber") % 2 == 0, "related_to").otherwise("bought_with")
    target = F.when(F.col("l_linenumber") == 3, F.col("l_suppkey") + 10_000_000).otherwise(F.col("l_orderkey") % 400 + 1)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("source_id"), kind.alias("edge_type"), target.alias("target_id"),
        (F.lit(START) + F.col("l_orderkey") % 365 * 24 * HOUR).alias("valid_from"),
        F.when(F.col("l_linenumber") == 1, 0).otherwise(F.lit(START) + (F.col("l_orderkey") % 365 + 30) * 24 * HOUR).alias("valid_to"),
        (F.lit(START) + F.col("l_partkey") % 200 * 24 * HOUR).alias("created_at"),
        F.when(F.col("l_quantity") < 40, 0).otherwise(F.lit(START) + (F.col("l_partkey") % 200 + 20) * 24 * HOUR).alias("expired_at"),
    )


EDGES = f"""edges AS (
    SELECT l_partkey AS source_id, CASE WHEN l_linenumber % 2 = 0 THEN 'related_to' ELSE 'bought_with' END AS edge_type,
           CASE WHEN l_linenumber = 3 THEN l_suppkey + 10000000 ELSE l_orderkey % 400 + 1 END AS target_id,
           {START} + l_orderkey % 365 * 24 * {HOUR} AS valid_from,
           CASE WHEN l_linenumber = 1 THEN 0 ELSE {START} + (l_orderkey % 365 + 30) * 24 * {HOUR} END AS valid_to,
           {START} + l_partkey % 200 * 24 * {HOUR} AS created_at,
           CASE WHEN l_quantity < 40 THEN 0 ELSE {START} + (l_partkey % 200 + 20) * 24 * {HOUR} END AS expired_at
    FROM lineitem)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time in milliseconds, rounded down."""
    return table(spark, sf_dir, "events").withColumn("ms", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long"))


EVENTS = "ev AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events)"


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, valid_from, value): each event is a version of its user."""
    return events(spark, sf_dir).select(F.col("user_id").alias("id"), F.col("ms").alias("valid_from"), "value")


VERSIONS = EVENTS + ", versions AS (SELECT user_id AS id, ms AS valid_from, value FROM ev)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    """One stored vector, as a query."""
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row.embedding]


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors not divisible by 4 are passages of the next lower record that is."""
    return vectors(spark, sf_dir).where("id % 4 <> 0").select("id", (F.col("id") - F.col("id") % 4).alias("parent_id"))


CHUNKS = "chunks AS (SELECT vec_id AS id, vec_id - vec_id % 4 AS parent_id FROM embeddings WHERE vec_id % 4 <> 0)"
