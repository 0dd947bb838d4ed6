"""Exact top-k search by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks; each block is sorted once, and all queries are streamed past it. In a block every dimension has a list of
the candidates sorted by that component. For a query the lists are read from the end that its component favours, all
at the same depth; candidates met are scored in full. No candidate that has not been met can score above the sum, over all
dimensions, of the query's component times the list's value at that depth; the search stops when this bound cannot
beat the k-th score. Vectors are quantised to integers, so scores and bounds are exact.

A first round scores one block for each query. Its k-th score there is a floor in the second round: a block whose bound is below it is left at once,
and gives on only what reaches it. So each candidate moves twice, whatever the number of queries, and each query once for each block of candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.llm.columns import taken
from tidepool.llm.scratch import cut

#: Candidates of one block, and components that its vectors have together, at most.
BLOCK, COMPONENTS = 16384, 1 << 20
_LONG = (1 << 63) - 1


def exactly(left: np.ndarray, right: np.ndarray) -> bool:
    """Whether 64-bit floats hold all sums of products of these integers."""
    most = [float(np.abs(x).max(initial=0)) for x in (left, right)]
    return most[0] * most[1] * max(left.shape[-1], 1) < 1 << 53


def as_integers(x: np.ndarray) -> np.ndarray:
    """The same whole numbers as Python's, of any size."""
    return np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)


class SortedLists:
    """One block of candidates with its sorted lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        place = np.argsort(ids, kind="stable")  # so that lower rows win ties
        self.ids, self.vectors = ids[place], np.ascontiguousarray(vectors[place].astype(float))
        self.order = np.argsort(self.vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, self.order, axis=0)
        self.large: tuple[np.ndarray, np.ndarray] | None = None
        self.reads = 0

    def search(self, own_id: int, query: np.ndarray, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """(score, id) of the best k with other ids than the query's, higher scores and then smaller ids first; none below the floor."""
        query, vectors, values = query.astype(float), self.vectors, self.values
        if not exactly(vectors, query):
            self.large = self.large or (as_integers(vectors), as_integers(values))
            query, (vectors, values) = as_integers(query), self.large
        n = len(vectors)
        met = self.ids == own_id
        best_scores, best_rows = np.zeros(0, query.dtype), np.zeros(0, np.int64)
        used = np.flatnonzero(query != 0)
        up = used[query[used] > 0]
        down = used[query[used] < 0]
        depth, step = 0, max(16, n // 256)
        if not len(used):
            step = n
        while not met.all():
            end = min(n, depth + step)
            if depth == 0 and floor is not None and len(used) and values[-1, up] @ query[up] + values[0, down] @ query[down] < floor:
                break
            fresh = np.zeros(n, bool)
            if len(used):
                fresh[self.order[n - end : n - depth, up]] = True
                fresh[self.order[depth:end, down]] = True
            else:
                fresh[:] = True
            fresh &= ~met
            met |= fresh
            rows = np.flatnonzero(fresh)
            self.reads += len(rows)
            scores = vectors[rows] @ query
            if floor is not None:
                rows, scores = rows[scores >= floor], scores[scores >= floor]
            best_scores = np.concatenate([best_scores, scores])
            best_rows = np.concatenate([best_rows, rows])
            place = np.lexsort((best_rows, -best_scores))[:k]
            best_scores, best_rows = best_scores[place], best_rows[place]
            if end >= n:
                break
            bound = values[n - end, up] @ query[up] + values[end - 1, down] @ query[down]
            if len(best_scores) == k and bound < best_scores[-1] or floor is not None and bound < floor:
                break
            depth, step = end, step * 2
        return [(int(s), int(self.ids[r])) for s, r in zip(best_scores, best_rows, strict=True)]


def plain_best(ids: np.ndarray, vectors: np.ndarray, own_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(score, id) of k of the best rows with other ids, in no order, by scoring all of them: for one query of many blocks this is less than sorting lists."""
    if not exactly(vectors, query):
        vectors, query = as_integers(vectors), as_integers(query)
    others = np.flatnonzero(ids != own_id)
    scores = (vectors @ query)[others]
    best = np.argsort(-scores, kind="stable")[:k] if len(scores) <= k or scores.dtype == object else np.argpartition(-scores, k - 1)[:k]
    return [(int(scores[i]), int(ids[others[i]])) for i in best]


def quantised(vectors: DataFrame, vector: str = "embedding", id_column: str = "vec_id", scale: int = 1024) -> DataFrame:
    """(vec_id, v array<double>): each component as floor(scale * x), a whole number. Vectors that are null, or hold a null or non-finite component, and rows without an id, are left out.

    A component so large that its product with ``scale`` is no longer finite is taken as the largest finite number. Columns are taken by place, so others may have
    any names; they are not returned. Repeated rows stay, an empty table stays empty.
    """
    whole = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(F.col("w"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = taken(vectors, vec_id=id_column, embedding=vector).select(F.col("vec_id").cast("long"), whole.alias("w"))
    own = own.where(F.col("w").isNotNull() & F.col("vec_id").isNotNull()).where(F.coalesce(finite, F.lit(False)))
    most = F.lit(float(np.finfo(float).max))
    return own.select("vec_id", F.transform("w", lambda x: whole_below(F.greatest(F.least(x * scale, most), -most))).alias("v"))


def whole_below(x: Column) -> Column:
    """The largest whole number not above x, as a double; beyond 2^53 all doubles are whole."""
    return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)


def _search(k: int, with_floor: bool, plain: bool):
    """For rows (c, dims, query, vec_id, floor, v) sorted by the first three: each query of a block against its candidates, by sorted lists unless ``plain``."""
    names = ["query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, lists = None, [], None
        for batch in batches:
            c, dims, query, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            floors = batch.column(4).to_pylist() if with_floor else [None] * len(ids)
            keys = np.column_stack([c, dims, query])
            begins = np.concatenate([[0], np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1, [len(keys)]]) if len(keys) else [0]
            rows: list[tuple[int, int, int]] = []
            for i, j in zip(begins[:-1], begins[1:], strict=True):
                if (c[i], dims[i]) != group:
                    group, held, lists = (c[i], dims[i]), [], None
                vectors = batch.column(5).slice(i, j - i).flatten().to_numpy(zero_copy_only=False).reshape(j - i, int(dims[i]))
                if not query[i]:
                    held.append((ids[i:j], vectors))
                    continue
                if held:
                    block, held = tuple(np.concatenate(x) for x in zip(*held, strict=True)), []
                    lists = block if plain else SortedLists(*block)
                if lists is None:
                    continue
                if plain:
                    for own_id, vector in zip(ids[i:j].tolist(), vectors, strict=True):
                        rows += [(own_id, found, max(-_LONG - 1, min(_LONG, score))) for score, found in plain_best(*lists, own_id, vector, k)]
                    continue
                for own_id, floor, vector in zip(ids[i:j].tolist(), floors[i:j], vectors, strict=True):
                    rows += [(own_id, found, max(-_LONG - 1, min(_LONG, score))) for score, found in lists.search(own_id, vector, k, floor)]
            yield pa.RecordBatch.from_arrays([pa.array([r[x] for r in rows], pa.int64()) for x in range(3)], names=names)

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the k best rows of ``candidates`` with another id.

    Both are tables as ``quantised`` makes them. Higher inner products first, ties to the smaller id; all rows if fewer than k. Vectors are
    compared with those of the same length only. Rows repeated in ``candidates`` are found as often as they stand there; a query id
    that repeats in ``queries`` is searched once, by the least of its vectors. Empty tables give an empty table. Sums are exact whatever
    the components; a score beyond 64 bits is given as the largest or smallest that 64 bits hold, and ties with others there. Other columns than ``vec_id`` and ``v`` are not read.
    """
    found = candidates.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    many = max(1, math.ceil(found.n / max(1, min(block, COMPONENTS // max(found.dims or 1, 1)))))
    size = F.size("v").alias("dims")
    own = candidates.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(many)).alias("c"), size, F.lit(0).alias("query"), "vec_id", F.lit(None).cast("long").alias("floor"), "v")
    asked = cut(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")

    def searched(blocks: Column, floors: DataFrame | None, plain: bool = False) -> DataFrame:
        each = asked.join(floors, "vec_id", "left") if floors is not None else asked.withColumn("floor", F.lit(None).cast("long"))
        each = each.select(F.explode(blocks).alias("c"), size, F.lit(1).alias("query"), "vec_id", "floor", "v")
        spread = own.unionByName(each).repartition("c").sortWithinPartitions("c", "dims", "query")
        return spread.mapInArrow(_search(k, floors is not None, plain), "query_id long, vec_id long, score long")

    def best(rows: DataFrame) -> DataFrame:
        place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)

    floors = None
    if many > 1:
        first = searched(F.array(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(many))), None, plain=True)
        floors = cut(first.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "floor"), "floors")
    return best(searched(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")), floors)).select("query_id", "rank", "vec_id", "score")
