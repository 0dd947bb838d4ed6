"""An index of vectors by cells, for nearest neighbours by cosine without a scan of all vectors.

Coarse centroids are fitted on a sample of at most ``SAMPLE`` rows, the first by a hash of their id; then every row is filed under the centroid nearest to it. A cell
is a folder of blocks: up to ``BLOCK`` ids with their vectors as one matrix. For each cell the index knows the least cosine of its vectors with the centroid, so it knows
how near to a query any of them can be. A search probes the cells whose centroids are nearest; how many is measured when the index is built, on the sample, so that
``RECALL`` of its true neighbours are found. On demand all cells are probed that can hold one of the k nearest, which gives the exact result.

Queries come as a table. Those that probe a cell are packed and meet the blocks of that cell, which a matrix product scores; only k rows for each query and block go on.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.operators.lineage import written

#: Rows that centroids are fitted on, rows of them that search all others to measure recall, the recall asked for, and rounds of the fit.
SAMPLE, MEASURED, RECALL, ROUNDS = 20_000, 500, 0.97, 12
#: Cells at most, vectors of a block, bytes of a file of blocks, queries that are packed together.
MOST_CELLS, BLOCK, FILE_BYTES, PACKED = 16_384, 1024, 64 << 20, 128
#: Neighbours for which recall is measured.
NEIGHBOURS = 10
#: Cosines that are held at a time, and bytes of vectors that are worth a task of their own where tasks are free.
HELD, LEAST_BYTES = 1 << 21, 1 << 20


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision; zero where they are all but zero, so that their distance from anything is 1."""
    m = matrix.astype(float)
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 1e-8)


def centroids_of(points: np.ndarray, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids by Lloyd's rounds from evenly chosen points; a cell that loses all points keeps its centroid."""
    centroids = points[np.linspace(0, len(points) - 1, count).astype(int)]
    for _ in range(rounds):
        own = nearest_cells(points, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        fresh = unit(sums)
        centroids = np.where(np.bincount(own, minlength=count)[:, None] > 0, fresh, centroids)
    return centroids


def parts_of(points: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Points, as many at a time as have ``HELD`` cosines with so many others; one empty part if there are none."""
    rows = max(1, HELD // max(1, width))
    for low in range(0, max(1, len(points)), rows):
        yield points[low : low + rows]


def nearest_cells(points: np.ndarray, centroids: np.ndarray, many: int) -> np.ndarray:
    """For each point the cells with the nearest centroids, the nearest first."""
    if many == 1:
        return np.concatenate([(part @ centroids.T).argmax(1)[:, None] for part in parts_of(points, len(centroids))])
    return np.concatenate([np.argsort(-(part @ centroids.T), axis=1, kind="stable")[:, :many] for part in parts_of(points, len(centroids))])


def probes_for(points: np.ndarray, centroids: np.ndarray, recall: float = RECALL) -> int:
    """The fewest cells in which that share of the true nearest points of some points is found, by comparing them with all."""
    asked = points[:: max(1, len(points) // MEASURED)]
    near = nearest_cells(asked, points, NEIGHBOURS + 1)[:, 1:]
    home = nearest_cells(points, centroids, 1)[:, 0]
    place = np.argsort(nearest_cells(asked, centroids, len(centroids)), axis=1)  # of each cell, in the order that a query probes
    depth = np.sort(np.take_along_axis(place, home[near], axis=1).ravel())
    return int(depth[min(len(depth) - 1, math.ceil(recall * len(depth)) - 1)]) + 1 if len(depth) else 1


def reach(cosine: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The largest cosine that a query can have with a vector of a cell, from its cosine with the centroid and the cell's least one."""
    angle = np.arccos(np.clip(cosine, -1, 1)) - np.arccos(np.clip(least, -1, 1))
    return np.cos(np.maximum(angle, 0.0)) + 1e-9


def _matrix(column: pa.Array, dims: int, where: str) -> np.ndarray:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != dims).any():
        raise ValueError(f"{where} of {int(sizes[sizes != dims][0])} components, where the index has {dims}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _filing(centroids: np.ndarray, kind: str):
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _matrix(batch.column(1), dims, "a vector")
            points = unit(matrix)
            # a vector that is all but zero is equally far from everything: any cell will do
            cells = nearest_cells(points, centroids, 1)[:, 0]
            least = (points * centroids[cells]).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells.astype(np.int32)), pa.array(least), pa.array([r.tobytes() for r in matrix.astype(kind)], pa.binary())], names=["id", "cell", "cosine", "raw"])

    return run


def _blocking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, id, cosine, raw) sorted by cell, as blocks."""
    names, held, last = ["cell", "n", "least", "ids", "vectors"], [], None

    def block(rows: list[tuple]) -> pa.RecordBatch:
        ids = [r[0] for r in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array([last], pa.int32()), pa.array([len(rows)], pa.int32()), pa.array([min(r[1] for r in rows)], pa.float64()), pa.array([ids]), pa.array([b"".join(r[2] for r in rows)], pa.binary())], names=names
        )

    for batch in batches:
        for cell, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (cell != last or len(held) == BLOCK):
                yield block(held)
                held = []
            last = cell
            held.append(row)
    if held:
        yield block(held)


def sampled(own: DataFrame, n: int) -> np.ndarray:
    """The vectors of the first ``SAMPLE`` rows of a table (id, v) of n rows, by a hash of their id; vectors of different lengths are refused.

    Rows whose hash is too high to be among the first are left out where they are read, so that neither the driver nor a task gets a sample of each partition.
    """
    code = F.xxhash64("id")
    first = lambda rows: rows.orderBy(code, "id").limit(SAMPLE).select("v").toArrow().column(0)
    highest = int((1 << 64) * min(1.0, 1.25 * SAMPLE / max(1, n))) - (1 << 63)
    got = first(own.where(code < highest) if highest < 1 << 62 else own)
    if len(got) < min(n, SAMPLE):  # ids that repeat
        got = first(own)
    sizes = np.unique(pc.list_value_length(got).to_numpy())
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes.tolist()} components")
    return pc.list_flatten(got).to_numpy().astype(float).reshape(len(got), sizes[0]) if len(sizes) else np.zeros((0, 0))


def build(vectors: DataFrame, path: str, id_column: str = "id", vector: str = "embedding", cells: int | None = None) -> VectorIndex:
    """Index the rows that have a vector under ``path``. Vectors of different lengths are refused.

    There are about as many cells as vectors in a cell, unless told. An empty table gives an index without cells.
    """
    spark = vectors.sparkSession
    own = vectors.where(F.col(vector).isNotNull()).select(F.col(id_column).alias("id"), F.col(vector).alias("v"))
    n = own.count()
    points = unit(sampled(own, n))
    points = points[(points != 0).any(1)] if len(points) and (points != 0).any() else points
    count = min(cells or max(1, round(math.sqrt(n))), MOST_CELLS, len(points))
    centroids = centroids_of(points, count) if count else np.zeros((0, 0))
    probes = probes_for(points, centroids) if count else 0
    id_type = own.schema["id"].dataType.simpleString()
    kind = "<f4" if own.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"
    if count:
        filed = own.mapInArrow(_filing(centroids, kind), f"id {id_type}, cell int, cosine double, raw binary")
        size = n * (points.shape[1] * int(kind[-1]) + 16)
        # ranges, not hashes, so that a crowded cell fills several files
        files = max(1, math.ceil(size / FILE_BYTES), min(spark.sparkContext.defaultParallelism, math.ceil(size / LEAST_BYTES)))
        dealt = filed.repartitionByRange(files, "cell", F.xxhash64("id")).sortWithinPartitions("cell")
        made = dealt.select("cell", "id", "cosine", "raw").mapInArrow(_blocking, f"cell int, n int, least double, ids array<{id_type}>, vectors binary")
        made.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/blocks")
        known = spark.read.parquet(f"{path}/blocks").groupBy("cell").agg(F.sum("n").cast("long").alias("n"), F.min("least").alias("least"))
        rows = [(k, c.tolist()) for k, c in enumerate(centroids)]
        fitted = spark.createDataFrame(rows, "cell int, centroid array<double>").join(known, "cell")
    else:
        fitted = spark.createDataFrame([], "cell int, centroid array<double>, n long, least double")
    fitted.select("*", F.lit(probes).alias("probes"), F.lit(kind).alias("kind"), F.lit(id_type).alias("id_type")).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return VectorIndex(spark, path)


class VectorIndex:
    """An index that ``build`` wrote. Only its cells, at most ``MOST_CELLS``, are held here."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        held = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
        self.cells = np.array([r.cell for r in held], np.int32)
        self.centroids = np.array([r.centroid for r in held], float)
        self.least = np.array([r.least for r in held], float)
        self.sizes = np.array([r.n for r in held], np.int64)
        self.probes, self.kind, self.id_type = (held[0].probes, held[0].kind, held[0].id_type) if held else (0, "<f8", "long")

    @functools.cached_property
    def _all(self) -> DataFrame:
        """Every block; the folders are listed once."""
        return self.spark.read.parquet(f"{self.path}/blocks")

    def blocks(self, cells: list[int] | None = None) -> DataFrame:
        """The blocks of these cells; folders of others aren't opened."""
        return self._all if cells is None or len(cells) == len(self.cells) else self._all.where(F.col("cell").isin(cells))

    def _probing(self, queries: DataFrame, probes: int, floors: DataFrame | None) -> DataFrame:
        """(query_id, v, cell): the cells that each query probes: the nearest, or with ``floors`` (query_id, floor) all that can reach the floor but the nearest."""
        cells, centroids, least, bounded = self.cells, self.centroids, self.least, floors is not None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points = unit(_matrix(batch.column(1), centroids.shape[1], "a query"))
                near = nearest_cells(points, centroids, probes) if probes else np.zeros((len(points), 0), int)
                if bounded:
                    can = reach(points @ centroids.T, least) >= batch.column(2).to_numpy(zero_copy_only=False)[:, None]
                    np.put_along_axis(can, near, False, axis=1)
                    chosen = [cells[row].tolist() for row in can]
                else:
                    chosen = cells[near].tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(chosen, pa.list_(pa.int32()))], names=["query_id", "v", "cells"])

        asked = queries if not bounded else queries.join(floors.hint("merge"), "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
        kind, own = (queries.schema[c].dataType.simpleString() for c in ("query_id", "v"))
        return asked.mapInArrow(run, f"query_id {kind}, v {own}, cells array<int>").select("query_id", "v", F.explode("cells").alias("cell"))

    def _scored(self, probing: DataFrame, k: int, many: int, slack: float) -> DataFrame:
        """(query_id, id, cosine): for each query and block of its cells the k nearest of other ids, and those that are nearly as near as the last of them."""
        probing = written(probing, "probing")
        wanted = [r.cell for r in probing.select("cell").distinct().collect()]  # cells are bounded
        pack = F.pmod(F.xxhash64("query_id"), F.lit(max(1, math.ceil(many / PACKED))))
        packed = probing.groupBy("cell", pack.alias("pack")).agg(F.collect_list("query_id").alias("queries"), F.flatten(F.collect_list("v")).alias("matrix"))
        kind, dims = self.kind, self.centroids.shape[1]
        query_type = probing.schema["query_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n, ids, raw, queries, matrix in zip(*(batch.column(c) for c in range(5)), strict=True):
                    ids, queries = np.array(ids.as_py(), object), queries.as_py()
                    points = unit(np.frombuffer(raw.as_py(), kind).reshape(n.as_py(), dims))
                    cosines = unit(np.array(matrix.values).reshape(len(queries), dims)) @ points.T
                    out = []
                    for query, row in zip(queries, cosines, strict=True):
                        row[ids == query] = -3.0
                        best = np.argpartition(-row, k - 1)[:k] if len(row) > k else np.arange(len(row))
                        best = np.flatnonzero(row >= row[best].min() - slack) if len(row) > k else best
                        out += [(query, ids[i], float(row[i])) for i in best if row[i] > -2.5]
                    columns = zip(*out, strict=True) if out else ([], [], [])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.column(3).type.value_type, batch.column(1).type.value_type, pa.float64()), strict=True)], names=["query_id", "id", "cosine"])

        # a query repeats for each of its cells, which files compress well: by their size packs would be broadcast through the driver
        both = self.blocks(wanted).join(packed.hint("merge"), "cell").select("n", "ids", "vectors", "queries", "matrix")
        return both.mapInArrow(run, f"query_id {query_type}, id {self.id_type}, cosine double")

    def search(self, queries: DataFrame, k: int = NEIGHBOURS, probes: int | None = None, exact: bool = False, digits: int = 6) -> DataFrame:
        """(query_id, rank, id, distance): for each row (query_id, v) its k nearest by cosine among other ids; equal distances, to ``digits`` places, by id.

        With ``exact`` a second round probes every cell that can hold a nearer one than the k-th of the first. Queries of another length than the vectors are refused.
        """
        return self._searched(queries, k, probes, [exact], digits)[0]

    def search_twice(self, queries: DataFrame, k: int = NEIGHBOURS, probes: int | None = None, digits: int = 6) -> tuple[DataFrame, DataFrame]:
        """What ``search`` gives without and with ``exact``; the first round is one for both."""
        return tuple(self._searched(queries, k, probes, [False, True], digits))

    def _searched(self, queries: DataFrame, k: int, probes: int | None, exact: list[bool], digits: int) -> list[DataFrame]:
        queries = written(queries.select("query_id", "v"), "queries")
        many, kind = queries.count(), queries.schema["query_id"].dataType.simpleString()
        if not len(self.cells) or not many:
            return [self.spark.createDataFrame([], f"query_id {kind}, rank int, id {self.id_type}, distance double")] * len(exact)
        probes = min(probes or self.probes, len(self.cells))
        found = self._scored(self._probing(queries, probes, None), k, many, 10.0**-digits)
        distance = F.round(F.greatest(F.lit(0.0), 1 - F.col("cosine")), digits)
        place = Window.partitionBy("query_id").orderBy("distance", "id")
        more = None
        if any(exact):
            found = written(found, "found")
            nth = found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine")))).where(F.col("place") == k)
            floors = nth.select("query_id", (F.col("cosine") - 10.0**-digits).alias("floor"))
            more = self._scored(self._probing(queries, probes, floors), k, many, 10.0**-digits)

        def best(rows: DataFrame) -> DataFrame:
            ranked = rows.withColumn("distance", distance).withColumn("rank", F.row_number().over(place))
            return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")

        return [best(found.unionByName(more)) if whole else best(found) for whole in exact]


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, hits, of): how many of the rows (query_id, id) of the exact result were found."""
    hits = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")).hint("merge"), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("of"))
