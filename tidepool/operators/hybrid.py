"""Fusing rankers: reciprocal ranks of vector, keyword and graph search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.functions.constants import ENTITY_SEEDS, RANKER_LIMIT, RRF_K
from tidepool.operators import keyword, vector


def ranked(found: DataFrame, by: str, ascending: bool = False) -> DataFrame:
    """With ``rank`` from 1; ``found`` is at most a ranker's limit long."""
    order = F.asc(by) if ascending else F.desc(by)
    return found.withColumn("rank", F.row_number().over(Window.orderBy(order, "id")))


def vector_ranker(table: DataFrame, chunks: DataFrame, query: list[float], limit: int = RANKER_LIMIT) -> DataFrame:
    """(id, rank, score): ranks count passages one by one, and a record has the rank of its best."""
    hits = ranked(vector.nearest(table, query, limit), "distance", ascending=True)
    parents = hits.join(chunks.select("id", "parent_id"), "id", "left")
    return vector.best_per_parent(parents.select(F.coalesce("parent_id", "id").alias("parent"), "rank", (1 - F.col("distance")).alias("score")))


def keyword_ranker(docs: DataFrame, query: str, limit: int = RANKER_LIMIT, stemmed: bool = False) -> DataFrame:
    """(id, rank, score) of records; entities in ``docs`` (kind 1) take ranks too and are then left out, so ranks may have gaps."""
    return keyword_ranks(keyword.search(docs, query, stemmed=stemmed), limit)


def keyword_ranks(found: DataFrame, limit: int = RANKER_LIMIT) -> DataFrame:
    """The same of what a keyword search found, by an index or without."""
    return keyword.top(found, limit).where("kind = 0").select("id", "rank", "score")


def graph_ranker(entities: DataFrame, edges: DataFrame, query: list[float], seeds: int = ENTITY_SEEDS, limit: int = RANKER_LIMIT) -> DataFrame:
    """(id, rank, score): what the nearest entities point to, one hop on, in the order of entity, edge type and target.

    The score is 1 over the place of the first entity that points there.
    """
    best = ranked(vector.nearest(entities, query, seeds), "distance", ascending=True).select(F.col("id").alias("source_id"), F.col("rank").alias("seed"))
    hops = best.join(edges.select("source_id", "edge_type", "target_id"), "source_id")
    first = hops.groupBy(F.col("target_id").alias("id")).agg(F.min(F.struct("seed", "edge_type")).alias("m")).select("id", F.col("m.seed").alias("seed"), F.col("m.edge_type").alias("edge_type"))
    best_first = first.orderBy("seed", "edge_type", "id").limit(limit)
    return best_first.select("id", F.row_number().over(Window.orderBy("seed", "edge_type", "id")).alias("rank"), (F.lit(1.0) / F.col("seed")).alias("score"))


def fuse(rankers: dict[str, DataFrame], k: int = RRF_K) -> DataFrame:
    """(id, score, one column ``<ranker>_score`` each): the sum of 1 / (k + rank) over the rankers that found a record."""
    parts = [found.select("id", F.lit(name).alias("ranker"), "rank", F.col("score").alias("own")) for name, found in rankers.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    own = [F.coalesce(F.max(F.when(F.col("ranker") == name, F.col("own"))), F.lit(0.0)).alias(f"{name}_score") for name in rankers]
    return every.groupBy("id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"), F.count(F.lit(1)).alias("rankers"), *own)


def truncated(fused: DataFrame, k: int) -> DataFrame:
    """(found, truncated): how many ids were found, records or not, and whether that is more than k."""
    return fused.agg(F.count(F.lit(1)).alias("found")).select("found", (F.col("found") > k).alias("truncated"))


def results(fused: DataFrame, memories: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """The k best that are records, with their content; ids that are none take no place."""
    known = fused.where(F.col("score") >= least).join(memories, "id")
    return known.orderBy(F.desc("score"), "id").limit(k)
