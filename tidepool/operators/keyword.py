"""Keyword search: BM25 with tiered matching.

A single query needs no postings: term counts of its few terms are computed where the documents are read, and only two
numbers for the corpus and one for each term are gathered. ``postings`` serve batches of queries; ``index`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.functions.constants import BM25_B, BM25_K1, LEAST_IDF, MOST_K, TOP_K
from tidepool.functions.stemming import normal, normal_terms
from tidepool.functions.text import phrase_count, query_phrases, query_words, terms
from tidepool.operators.lineage import written


def clamp_k(k: int) -> int:
    """A result size as queries may ask for: 10 if not positive, 50 at most."""
    return min(k if k > 0 else TOP_K, MOST_K)


def tokenised(docs: DataFrame, text: str | list[str] = "content", stemmed: bool = False) -> DataFrame:
    """``docs`` with ``tokens``: the terms of one column, or of several one after the other (null ones empty). ``stemmed``: without diacritics and suffixes."""
    columns = [text] if isinstance(text, str) else text
    own = terms(F.concat_ws(" ", *columns))
    return docs.withColumn("tokens", normal_terms(own) if stemmed else own)


def idf(n_docs: Column, n_with: Column) -> Column:
    return F.greatest(F.log((n_docs - n_with + 0.5) / (n_with + 0.5)), F.lit(LEAST_IDF))


def term_weight(tf: Column, length: Column, average: Column) -> Column:
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / average))


def scored(docs: DataFrame, phrases: list[list[str]], every: bool = False) -> DataFrame:
    """(all columns but tokens, ``score``) of the documents with at least one of the phrases, or with all of them. ``docs`` has ``tokens``."""
    return _found(docs, phrases, [True] * len(phrases), "and" if every else "or")


def asked(query: str, stemmed: bool = False) -> tuple[list[list[str]], list[bool]]:
    """The phrases of a query, and which of them a strict search needs."""
    words = [(w, query_phrases(w, False)) for w in query_words(query, False)]
    kept = {w.lower() for w in query_words(query, True)}
    phrases = [(p[0], w.lower() in kept) for w, p in words if p]
    if stemmed:
        phrases = [([normal(t) for t in p], strict) for p, strict in phrases]
    return [p for p, _ in phrases], [strict for _, strict in phrases]


def search(docs: DataFrame, query: str, tier: str = "tiered", stemmed: bool = False) -> DataFrame:
    """The matching documents with ``score``, unsorted. ``stemmed`` is as for ``tokenised``, and has to be the same.

    ``and``: all words but stopwords. ``or``: any word. ``tiered``: the first, unless nothing matches; then the second.
    """
    return _found(docs, *asked(query, stemmed), tier, stemmed)


def _found(docs: DataFrame, phrases: list[list[str]], strict: list[bool], tier: str, kept: bool = False) -> DataFrame:
    """Two passes: one aggregate of one row has the number and average length of all documents, the documents of each phrase, and
    whether any document has all strict phrases; then documents are scored and chosen by it. Both tiers are one plan. ``kept``: terms are dear, so counts are written between the passes.
    """
    if not phrases:
        return docs.drop("tokens").withColumn("score", F.lit(0.0)).where(F.lit(False))
    counts = [phrase_count(F.col("tokens"), p).alias(f"_f{k}") for k, p in enumerate(phrases)]
    counted = docs.select("*", F.size("tokens").alias("_len"), *counts).drop("tokens")
    return chosen(written(counted, "counts") if kept else counted, None, strict, tier)


def chosen(counted: DataFrame, corpus: DataFrame | None, strict: list[bool], tier: str) -> DataFrame:
    """Documents with their length ``_len`` and phrase counts ``_f0`` and so on, chosen and scored.

    ``corpus`` is one row (_n, _avg); without it ``counted`` has every document. Where nothing is found, nothing is scored.
    """
    names = [f"_f{k}" for k in range(len(strict))]
    has = [F.col(f) > 0 for f in names]
    all_strict, any_word = F.lit(True), F.lit(False)
    for found, needed in zip(has, strict, strict=True):
        all_strict = all_strict & found if needed else all_strict
        any_word = any_word | found
    number = lambda hit: F.count(F.when(hit, 1))
    sizes = [] if corpus is not None else [F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg")]
    totals = counted.agg(*sizes, number(all_strict).alias("_both"), *[number(hit).alias(f"_n{f}") for hit, f in zip(has, names, strict=True)])
    if corpus is not None:
        totals = totals.crossJoin(F.broadcast(corpus))  # one row each
    parts = [
        F.when(hit, idf(F.col("_n"), F.col(f"_n{f}")) * term_weight(F.col(f), F.col("_len"), F.col("_avg"))).otherwise(0.0)
        for hit, f in zip(has, names, strict=True)
    ]
    loose = sum(parts[1:], parts[0])
    own = [p for p, needed in zip(parts, strict, strict=True) if needed]
    firm = sum(own[1:], own[0])
    by_strict = {"and": F.lit(True), "or": F.lit(False), "tiered": F.col("_both") > 0}[tier]
    # the totals are one row; the choice looks at them, so that it isn't made, and terms aren't found, a second time below the join
    both = counted.crossJoin(F.broadcast(totals))
    found = both.where(F.when(F.col("_n") > 0, F.when(by_strict, all_strict).otherwise(any_word)).otherwise(False))
    hidden = ["_len", "_n", "_avg", "_both", *names, *[f"_n{f}" for f in names]]
    return found.withColumn("score", F.when(by_strict, firm).otherwise(loose)).drop(*hidden)


def top(found: DataFrame, k: int, score: str = "score", id_column: str = "id") -> DataFrame:
    """The k best, ties by id, with ``rank`` from 1: a bounded heap on each partition, then a sort of what is left."""
    best = found.orderBy(F.desc(score), id_column).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), id_column)))


# ---------------------------------------------------------------- batches of queries


def postings(docs: DataFrame, id_column: str = "id") -> DataFrame:
    """(id, term, tf, len) of a table with ``tokens``: the inverted index. Counts are summed within a document, before any shuffle."""
    each = docs.select(F.col(id_column).alias("id"), F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
    return each.groupBy("id", "term", "len").agg(F.count(F.lit(1)).alias("tf"))


def doc_stats(docs: DataFrame) -> DataFrame:
    """(n, average): one row."""
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("average"))


def search_batch(index: DataFrame, stats: DataFrame, queries: DataFrame, k: int = TOP_K, digits: int = 9) -> DataFrame:
    """(query_id, rank, id, score): the k best of each query of a table (query_id, term), by any of its terms.

    Scores that are equal to ``digits`` places tie, so that the order of sums decides nothing; ties go to the smaller id.
    ``index`` is ``postings``. Frequent terms are joined without gathering their postings; ranks are cut on each side of the last shuffle.
    """
    wanted = queries.dropDuplicates(["query_id", "term"])
    used = index.join(wanted.select("term").distinct(), "term", "left_semi")
    frequency = used.groupBy("term").agg(F.count(F.lit(1)).alias("n_with"))
    asked = wanted.join(frequency, "term").crossJoin(F.broadcast(stats))
    weights = asked.select("query_id", "term", "average", idf(F.col("n"), F.col("n_with")).alias("idf"))
    hits = used.join(weights, "term").groupBy("query_id", "id").agg(F.sum(F.col("idf") * term_weight(F.col("tf"), F.col("len"), F.col("average"))).alias("score"))
    place = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), "id")
    return hits.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
