"""Near copies by SimHash, verified: texts that have at least four fifths of their word shingles in common (Jaccard).

Fingerprints are those of ``simhash``, 256 bits wide, of the different five-word shingles. Two texts of similarity 0.8 differ in a
bit with probability acos(2 * 0.8 / 1.8) / pi, 0.152, so some 39 of 256; fingerprints are linked up to ``RADIUS`` bits, compared bit-sliced where they
share one of a number of sampled keys that lets fewer than one pair in a thousand at 0.8 share none. Unrelated texts differ in some 128 bits and are
within the radius with probability 1e-16, so that even of 100 billion texts hardly any has a neighbour by chance, and chains of such neighbours don't join pools.
Texts that links lead to from one another are one pool; within a pool the shingle sets of all texts are compared, so nothing below the similarity is linked. A pool
with many texts is dealt over several tasks; each task gives on a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.bytestext import slices, small_batches, utf8
from tidepool.llm.columns import at, kept, numbered, taken
from tidepool.llm.components import connected_components
from tidepool.llm.scratch import cut
from tidepool.llm.simhash import Forest, shingle_hashes, wide_fingerprint, wide_links

#: Words of a shingle, and the similarity from which on two texts are copies: 4 / 5.
WORDS, SHARED, OF = 5, 4, 5
#: 64-bit words of a fingerprint, and the radius: 4 deviations above what two texts at the similarity differ in.
PRINT_WORDS, RADIUS = 4, 62
PRINT = [f"w{k}" for k in range(PRINT_WORDS)]
#: How likely two texts at the similarity have an equal bit; less than by the formula above, for texts of few shingles.
AGREE = 0.845
#: Texts of one pool whose shingles one task holds on each side.
TILE = 512


def shingle_set(raw: bytes, words: int = WORDS) -> np.ndarray:
    """The different shingles of a text as sorted hashes; a text without words has none."""
    return np.unique(shingle_hashes(raw, words))


def text_key(text: str | Column) -> Column:
    """A hash that stands for a text; null counts as empty."""
    return F.xxhash64(utf8(text))


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        words = np.array([wide_fingerprint(shingle_set(x.as_py()), PRINT_WORDS) for x in batch.column(1)], np.uint64).reshape(-1, PRINT_WORDS).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(PRINT_WORDS))], names=["node", *PRINT])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        sets = [shingle_set(x.as_py()).tobytes() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])


def spanning_links(sets: list[np.ndarray], side: np.ndarray, apart: bool) -> list[tuple[int, int]]:
    """Pairs of indexes that span the classes of similar sets; ``apart`` compares only sets of different sides."""
    n, forest, out = len(sets), Forest(len(sets)), []
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for i in range(n):
        low, high = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        counts = high - low
        total = int(counts.sum())
        places = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(total)
        common = np.bincount(owner[places], minlength=n)
        alike = OF * common >= SHARED * (sizes + sizes[i] - common)
        alike[: i + 1] = False
        if apart:
            alike &= side != side[i]
        for j in np.flatnonzero(alike).tolist():
            if forest.joins(i, j):
                out.append((i, j))
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (root, tile, other, side, node, shingles) sorted by the first three: the links that each group spans."""
    group, nodes, sides, sets = None, [], [], []

    def links() -> pa.RecordBatch:
        found = spanning_links(sets, np.array(sides), group[1] != group[2])
        return pa.RecordBatch.from_arrays([pa.array([nodes[p[k]] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for *at, side, node, raw in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if at != group:
                if len(nodes) > 1:
                    yield links()
                group, nodes, sides, sets = at, [], [], []
            nodes.append(node)
            sides.append(side)
            sets.append(np.frombuffer(raw, np.uint64))
    if len(nodes) > 1:
        yield links()


def copy_links(docs: DataFrame, text: str = "text", tile: int = TILE) -> DataFrame:
    """(a, b): links that span every class of different texts, by their keys."""
    own = small_batches(taken(docs, text=text)).select(text_key("text").alias("node"), utf8("text").alias("text"))
    printed = cut(own.mapInArrow(_printed, ", ".join(f"{c} long" for c in ["node", *PRINT])), "prints")
    once = cut(printed.distinct(), "prints")
    roots = connected_components(wide_links(once.select(*PRINT).distinct(), RADIUS, AGREE))
    # texts of one fingerprint are one pool with or without links
    pools = once.select(F.col("node"), "w0").join(roots.withColumnRenamed("node", "w"), F.col("w0") == F.col("w"), "left").select("node", F.coalesce("root", "w0").alias("root"))
    pools = cut(pools, "pools")
    tiles = pools.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root", F.ceil(F.col("n") / tile).cast("long").alias("tiles"))
    # written first: in a join of two tables read from files Spark can split a hot pool, and send a small table of pools to all tasks
    pools = cut(pools.join(cut(tiles, "tiles"), "root"), "pools")
    sets = own.join(pools.select("node"), "node", "left_semi").mapInArrow(_shingled, "node long, shingles binary")
    sets = cut(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "shingles")
    dealt = pools.withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("tiles")))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("with")
    tasks = dealt.select("root", "node", "own", each).select(
        "root",
        F.least("own", "with").alias("tile"),
        F.greatest("own", "with").alias("other"),
        (F.col("own") > F.col("with")).cast("long").alias("side"),
        "node",
    )
    spread = tasks.join(sets, "node").select("root", "tile", "other", "side", "node", "shingles")
    spread = spread.repartition("root", "tile", "other").sortWithinPartitions("root", "tile", "other")
    return spread.mapInArrow(_verified, "a long, b long").distinct()


def first_of_each(docs: DataFrame, text: str = "text", id_column: str = "doc_id", tile: int = TILE) -> DataFrame:
    """The documents with one row left of each class of near copies; all columns of ``docs`` stay, whatever their names.

    That is the row with the smallest id, ids before null; of rows with equal ids the one whose text and then whose row has the smallest hash.
    Rows with equal ids whose texts are no near copies stay. Null texts count as empty; texts without words are one class. Texts of any length are read
    whole, an empty table gives an empty table.
    """
    own = numbered(docs)
    marked = own.withColumns({"node": text_key(at(docs, text)), "row": F.xxhash64(*kept(docs)), "id": at(docs, id_column)})
    roots = cut(connected_components(copy_links(docs, text, tile)), "roots")
    named = marked.select("id", "node", "row").join(roots.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node", "row")).alias("m")
    left = named.groupBy(F.coalesce("root", "node").alias("class")).agg(best).select("m.node", "m.row")
    chosen = marked.join(cut(left, "kept"), ["node", "row"], "left_semi")
    return chosen.dropDuplicates(["node", "row"]).select(*kept(docs)).toDF(*docs.columns)
