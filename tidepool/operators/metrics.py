"""Retrieval quality and latency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.functions.text import normalised_answer


def retrieval(results: DataFrame, k: int) -> DataFrame:
    """(query_id, hit, dcg, ndcg) of a table (query_id, rank, relevant 0/1), over the first k ranks.

    The ideal order is that of what was retrieved: relevant rows that were not do not lower the gain.
    """
    top = results.where(F.col("rank") <= k)
    ideal = Window.partitionBy("query_id").orderBy(F.desc("relevant"), "rank")
    both = top.withColumn("_best", F.row_number().over(ideal))
    gain = lambda place: F.sum(F.col("relevant") / F.log2(F.col(place) + F.lit(1.0)))
    summed = both.groupBy("query_id").agg(F.max("relevant").alias("hit"), gain("rank").alias("dcg"), gain("_best").alias("_idcg"))
    return summed.select("query_id", "hit", "dcg", F.when(F.col("_idcg") > 0, F.col("dcg") / F.col("_idcg")).otherwise(0.0).alias("ndcg"))


def session_recall(results: DataFrame, correct: DataFrame) -> DataFrame:
    """(query_id, session_recall): what part of the correct ids (query_id, id) stands anywhere in the results (query_id, id, ...)."""
    found = results.select("query_id", "id", F.lit(1).alias("found")).distinct()
    each = correct.select("query_id", "id").distinct().join(found, ["query_id", "id"], "left")
    return each.groupBy("query_id").agg((F.count("found") / F.count(F.lit(1))).alias("session_recall"))


def answers_found(results: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, answer_found): whether the contents of a query's results, one after the other, hold its answer; (query_id, rank, content), (query_id, answer).

    Case, punctuation and runs of space make no difference. An answer of these alone is never found. A query's results are few, as a search gives them.
    """
    said = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("r"))
    text = normalised_answer(F.array_join(F.transform("r", lambda x: F.coalesce(x["content"], F.lit(""))), " "))
    own = answers.select("query_id", normalised_answer("answer").alias("a")).join(said.select("query_id", text.alias("t")), "query_id", "left")
    return own.select("query_id", F.coalesce((F.col("a") != "") & F.contains("t", F.col("a")), F.lit(False)).alias("answer_found"))


def ranker_contributions(results: DataFrame, rankers: tuple[str, ...] = ("vector", "keyword", "graph")) -> DataFrame:
    """(query_id, results, has_..., avg_...): how many results each ranker found (a score above 0 in its column ``..._score``), and their mean score."""
    score = lambda n: F.when(F.col(f"{n}_score") > 0, F.col(f"{n}_score"))
    hits = [F.count(score(n)).alias(f"has_{n}") for n in rankers]
    means = [F.round(F.coalesce(F.avg(score(n)), F.lit(0.0)), 4).alias(f"avg_{n}") for n in rankers]
    return results.groupBy("query_id").agg(F.count(F.lit(1)).alias("results"), *hits, *means)


def misses(correct: DataFrame, by: str, k: int = 5) -> DataFrame:
    """Of queries with no correct id among the first k: (by, queries, missed, not_retrieved, ranked_low, median_rank, least_rank, most_rank).

    ``correct`` has a row (query_id, by, rank) for each correct id, with null rank where it is not among the results. The median is the upper one.
    """
    firsts = correct.groupBy("query_id").agg(F.min("rank").alias("_first"))
    own = correct.join(firsts, "query_id")
    missed = F.coalesce(F.col("_first"), F.lit(k + 1)) > k
    low = F.when(missed & (F.col("rank") > k), F.col("rank"))
    return own.groupBy(by).agg(
        F.countDistinct("query_id").alias("queries"),
        F.countDistinct(F.when(missed, F.col("query_id"))).alias("missed"),
        F.count(F.when(missed & F.col("rank").isNull(), 1)).alias("not_retrieved"),
        F.count(low).alias("ranked_low"),
        # counted by rank, not gathered: the value at place n / 2 + 1 in order of value, for an even and an odd n
        F.expr(f"-percentile_disc(0.5) WITHIN GROUP (ORDER BY -CASE WHEN coalesce(_first, {k + 1}) > {k} AND rank > {k} THEN rank END)").cast(correct.schema["rank"].dataType).alias("median_rank"),
        F.min(low).alias("least_rank"),
        F.max(low).alias("most_rank"),
    )


def percentiles(values: DataFrame, by: str, value: str) -> DataFrame:
    """p50, p95, p99 by linear interpolation, and the extremes."""
    share = lambda p: F.percentile(value, F.lit(p))
    return values.groupBy(by).agg(
        F.count(value).alias("n"), share(0.5).alias("p50"), share(0.95).alias("p95"), share(0.99).alias("p99"), F.min(value).alias("least"), F.max(value).alias("most")
    )
