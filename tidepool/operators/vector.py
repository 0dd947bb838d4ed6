"""Vector search: exact nearest neighbours, and passages rolled up to their documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.functions import vectors
from tidepool.operators.lineage import checkpointed, written
from tidepool.operators.vindex import centroids_of, nearest_cells, sampled

#: Vectors of one block where they are compared, at most, and at least where they are dealt over free tasks; blocks of vectors that are streamed past one; pivots at most; cosines that are held.
BLOCK, LEAST, STREAMED, PIVOTS, HELD = 16_384, 1024, 8, 1024, 1 << 22


def nearest(table: DataFrame, query: list[float], k: int, metric: str = "cosine", vector: str = "embedding", id_column: str = "id") -> DataFrame:
    """(id, distance): the k rows nearest to the query, ties by id; ``dot`` gives the negated inner product.

    Rows without a vector are left out; a vector of another length is refused.
    """
    own, asked = F.col(vector), vectors.literal(query)
    distance = {"cosine": vectors.cosine_distance, "l2": vectors.l2_distance, "dot": lambda a, b: -vectors.dot(a, b)}[metric](own, asked)
    refused = F.raise_error(F.concat(F.lit("a vector of "), F.size(own).cast("string"), F.lit(f" components, asked for {len(query)}"))).cast("double")
    distance = F.when(F.size(own) == len(query), distance).otherwise(refused)
    return table.where(own.isNotNull()).select(F.col(id_column), distance.alias("distance")).orderBy("distance", id_column).limit(k)


def semantic(table: DataFrame, chunks: DataFrame, memories: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, content, tier, score): passages and whole records compete for k places; passages stand for their record.

    As the k places are given before passages of one record are united and unknown records dropped, fewer may come back.
    ``table`` is (id, embedding) of both kinds, ``chunks`` (id, parent_id).
    """
    raw = nearest(table, query, k)
    parents = raw.join(chunks.select("id", "parent_id"), "id", "left").select(F.coalesce("parent_id", "id").alias("id"), "distance")
    first = parents.groupBy("id").agg(F.min("distance").alias("distance"))
    return first.join(memories.select("id", "content", "tier"), "id").select("id", "content", "tier", (1 - F.col("distance")).alias("score"))


def _homes(table: DataFrame, vector: str, cells: int | None) -> tuple[DataFrame, np.ndarray]:
    """(id, v, home, cosine) with the nearest pivot of each vector as its home, and the pivots: fitted on a sample, at most ``PIVOTS``."""
    own = written(table.where(F.col(vector).isNotNull()).select("id", vectors.normalised(vector).alias("v")), "units")
    n = own.count()
    sample = sampled(own, n)
    count = min(cells or max(1, math.isqrt(n) // 4), PIVOTS, len(sample))
    pivots = centroids_of(sample, count) if count else np.zeros((0, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            home = nearest_cells(points, pivots, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), pa.array((points * pivots[home]).sum(1))], names=["id", "v", "home", "cosine"])

    kind = own.schema["id"].dataType.simpleString()
    homes = own.mapInArrow(run, f"id {kind}, v array<double>, home int, cosine double") if count else own.selectExpr("*", "0 AS home", "0D AS cosine")
    return written(homes, "homes"), pivots


def _visiting(table: DataFrame, distance: float, vector: str, cells: int | None) -> tuple[DataFrame, DataFrame]:
    """The rows (id, v, home) of a table, and (id, v, cells): the cells, the own one and later ones, in which a row can have a neighbour below the cosine distance.

    Angles keep the triangle inequality: a row can be near a row of a cell only if its angle to the cell's pivot is at most the angle of the distance more than the
    widest angle in that cell. So each pair that can be near meets once, in the later of its two cells. From a distance of 1 on nothing is ruled out.
    """
    homes, pivots = _homes(table, vector, cells)
    least = {r.home: r.c for r in homes.groupBy("home").agg(F.min("cosine").alias("c")).collect()}  # one row for each pivot
    limit = np.arccos(max(-1.0, 1 - distance)) if distance < 1 else 2 * np.pi
    widest = np.array([np.arccos(np.clip(least.get(c, 1.0), -1, 1)) for c in range(len(pivots))])
    known = np.array([c in least for c in range(len(pivots))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            home = batch.column(2).to_numpy(zero_copy_only=False)
            can = (np.arccos(np.clip(points @ pivots.T, -1, 1)) <= limit + widest + 1e-9) & known & (np.arange(len(pivots)) >= home[:, None])
            can[np.arange(len(home)), home] = True
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([np.flatnonzero(row).tolist() for row in can], pa.list_(pa.int32()))], names=["id", "v", "cells"])

    kind = homes.schema["id"].dataType.simpleString()
    visiting = homes.select("id", "v", "home").mapInArrow(run, f"id {kind}, v array<double>, cells array<int>") if len(pivots) else homes.selectExpr("id", "v", "array(0) AS cells")
    return homes, visiting


def visits(table: DataFrame, distance: float, vector: str = "embedding", cells: int | None = None) -> tuple[DataFrame, DataFrame]:
    """As ``_visiting``, the second with a row (id, v, cell) for each cell."""
    homes, visiting = _visiting(table, distance, vector, cells)
    return homes, visiting.select("id", "v", F.explode("cells").alias("cell"))


def tiles_of(sizes: dict[int, int], block: int) -> dict[int, int]:
    """A tile for each cell, by cells in order: as many as have ``block`` rows together, a larger cell by itself."""
    out, tile, held = {}, 0, 0
    for cell in sorted(sizes):
        if held and held + sizes[cell] > block:
            tile, held = tile + 1, 0
        out[cell], held = tile, held + sizes[cell]
    return out


def share_compared(table: DataFrame, distance: float, vector: str = "embedding", cells: int | None = None) -> DataFrame:
    """(compared, pairs): how many pairs ``lowest_neighbours`` compares, and how many there are."""
    homes, visiting = visits(table, distance, vector, cells)
    here = homes.groupBy(F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    come = visiting.groupBy("cell").agg(F.count(F.lit(1)).alias("m"))
    # in its own cell a pair meets twice, and each row itself
    compared = here.join(come, "cell").agg(F.sum(F.expr("n * (m - n) + n * (n - 1) DIV 2")).cast("long").alias("compared"))
    return compared.crossJoin(homes.agg(F.expr("count(1) * (count(1) - 1) DIV 2").cast("long").alias("pairs")))


def lowest_neighbours(table: DataFrame, distance: float, vector: str = "embedding", cells: int | None = None, block: int = BLOCK) -> DataFrame:
    """(id, parent): for each row the row of lowest id before it whose cosine distance is below the given one, if there is any.

    Rows meet only in cells of pivots that the triangle inequality leaves (``visits``). Cells share tiles of up to ``block`` rows, and a row moves once to each tile that has cells it visits. A crowded
    cell is dealt over several blocks, by a hash. What visits a tile is streamed past it, in several packs if it is much; of each only the lowest neighbour of each row goes on, so no group becomes all its pairs.
    """
    homes, visiting = _visiting(table, distance, vector, cells)
    visiting = written(visiting, "visits")
    sizes = {r.home: r["count"] for r in homes.groupBy("home").count().collect()}  # one row for each pivot
    block = min(block, max(LEAST, math.ceil(sum(sizes.values()) / (2 * table.sparkSession.sparkContext.defaultParallelism))))
    tile_of = tiles_of(sizes, block)
    told = np.array([tile_of.get(c, -1) for c in range(max(tile_of, default=0) + 1)], np.int32)
    kind = homes.schema["id"].dataType.simpleString()

    def by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            row, cell = np.repeat(np.arange(len(batch)), column.value_lengths().to_numpy(zero_copy_only=False)), column.flatten()
            tile = told[cell.to_numpy(zero_copy_only=False)]
            # cells are in order, and so are tiles
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (tile[1:] != tile[:-1])])) if len(row) else row
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), cell)
            for low in range(0, len(first), 4096):
                part = slice(low, low + 4096)
                take = pa.array(row[first[part]])
                yield pa.RecordBatch.from_arrays([pa.array(tile[first[part]]), batch.column(0).take(take), batch.column(1).take(take), lists[part]], names=["tile", "id", "v", "cells"])

    counts = {}
    for cell, tile in tile_of.items():
        counts[tile] = counts.get(tile, 0) + sizes[cell]
    come = visiting.select("cells").mapInArrow(lambda batches: _tiles_visited(batches, told), "tile int, n long").groupBy("tile").agg(F.sum("n").alias("n"))
    come = {r.tile: r.n for r in come.collect()}  # one row for each tile
    parted = [(c, t, math.ceil(counts[t] / block), math.ceil(come.get(t, 0) / (block * STREAMED))) for c, t in tile_of.items()]
    parted = table.sparkSession.createDataFrame(parted, "home int, tile int, blocks int, packs int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = homes.join(F.broadcast(parted), "home").select("tile", part("blocks").alias("block"), every("packs").alias("pack"), F.lit(0).alias("side"), "id", "v", F.array("home").alias("cells"))
    right = visiting.mapInArrow(by_tile, f"tile int, id {kind}, v array<double>, cells array<int>").join(F.broadcast(parted.select("tile", "blocks", "packs").distinct()), "tile")
    right = right.select("tile", every("blocks").alias("block"), part("packs").alias("pack"), F.lit(1).alias("side"), "id", "v", "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, own = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)])
            cuts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0), [True]])) if len(batch) else []
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                *key, side = keys[:, low].tolist()
                if key != last:
                    last, held, own = key, [], None
                rows = batch.slice(low, high - low)
                if side == 0:
                    held.append(rows)
                elif held:
                    own = own or _by_home(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    for ids, parents in _lowest(own, rows, distance):
                        yield pa.RecordBatch.from_arrays([ids, parents], names=["id", "parent"])

    spread = left.unionByName(right).repartition("tile", "block", "pack").sortWithinPartitions("tile", "block", "pack", "side")
    return spread.mapInArrow(run, f"id {kind}, parent {kind}").groupBy("id").agg(F.min("parent").alias("parent"))


def _tiles_visited(batches: Iterator[pa.RecordBatch], told: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(tile, n): how many rows (cells) visit a tile."""
    for batch in batches:
        column = batch.column(0)
        row, tile = np.repeat(np.arange(len(batch)), column.value_lengths().to_numpy(zero_copy_only=False)), told[column.flatten().to_numpy(zero_copy_only=False)]
        each = tile[np.concatenate([[True], (row[1:] != row[:-1]) | (tile[1:] != tile[:-1])])] if len(row) else tile
        found, n = np.unique(each, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(n.astype(np.int64))], names=["tile", "n"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_home(rows: pa.RecordBatch) -> dict[int, tuple[pa.Array, np.ndarray]]:
    """The ids and vectors of each cell, in order of id."""
    home = rows.column("cells").flatten().to_numpy(zero_copy_only=False)
    out = {}
    for cell in np.unique(home).tolist():
        own = rows.take(pa.array(np.flatnonzero(home == cell)))
        own = own.take(pc.sort_indices(own.column("id")))
        out[cell] = own.column("id"), _matrix(own.column("v"))
    return out


def _lowest(own: dict[int, tuple[pa.Array, np.ndarray]], rows: pa.RecordBatch, distance: float) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, parents): the lowest neighbour before each row, of rows of cells and rows that visit them; a row for each side."""
    rows = rows.take(pc.sort_indices(rows.column("id")))
    sizes = rows.column("cells").value_lengths().to_numpy(zero_copy_only=False)
    row, cell, ids, vectors = np.repeat(np.arange(len(rows)), sizes), rows.column("cells").flatten().to_numpy(zero_copy_only=False), rows.column("id"), _matrix(rows.column("v"))
    for home, (names, points) in own.items():
        at = row[cell == home]
        if not len(at):
            continue
        others, come = vectors[at], ids.take(pa.array(at))
        step = max(1, HELD // len(at))
        for low in range(0, len(names), step):
            near = 1 - points[low : low + step] @ others.T < distance
            here = names.slice(low, step)
            # both sides are in order of id, so the first that is near is the lowest
            for found, high, lower in ((near, here, come), (near.T, come, here)):
                hit = np.flatnonzero(found.any(1))
                first, second = high.take(pa.array(hit)), lower.take(pa.array(found[hit].argmax(1)))
                before = pc.less(second, first)
                yield first.filter(before), second.filter(before)


def greedy_clusters(table: DataFrame, distance: float, cells: int | None = None, rounds: int = 40) -> DataFrame:
    """(id, cluster): each row joins the row of lowest id before it that is near enough, and thereby that row's cluster.

    A row without such a neighbour founds a cluster. Following the links takes as many rounds as their longest chain doubles.
    """
    parent = lowest_neighbours(table, distance, cells=cells)
    state = table.select("id").join(parent, "id", "left").select("id", F.coalesce("parent", "id").alias("cluster"))
    for _ in range(rounds):
        state = checkpointed(state)
        onward = state.select(F.col("id").alias("cluster"), F.col("cluster").alias("next"))
        moved = state.join(onward, "cluster").select("id", "cluster", F.col("next").alias("to"))
        if moved.where("to <> cluster").isEmpty():
            break
        state = moved.select("id", F.col("to").alias("cluster"))
    return state


def best_per_parent(ranked: DataFrame) -> DataFrame:
    """(id, rank, score) of a table (parent, rank, score): the best rank of each parent and its score."""
    return ranked.groupBy(F.col("parent").alias("id")).agg(F.min("rank").alias("rank"), F.max("score").alias("score"))


def first_of_parent(ranked: DataFrame) -> DataFrame:
    """As ``best_per_parent``, keeping whole rows."""
    place = Window.partitionBy("parent").orderBy("rank")
    return ranked.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")
