"""Product codes of vectors: codebooks by Lloyd's method with sums that are kept up to date, and a byte for each part of a vector.

Components become integers, and vectors stand in blocks, written once and bucketed by block. Each round reads the blocks beside the assignments of the round before,
assigns all parts anew, and writes the new assignments. Of the sums only what changed moves: each part whose entry changed is taken from the
old entry's sum and added to the new one's, summed within a block, then by Spark. The running sums and counts, one for each entry, are added to on the driver;
their number is fixed by the parameters, whatever the number of vectors. All sums are of integers, so no order of tasks changes them.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.columns import taken
from tidepool.llm.groups import salt, share_totals
from tidepool.llm.scratch import bucket_count, cut, cut_bucketed

#: Of a code: parts of a vector, entries of a part's codebook, rounds, and what a component is multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of one block, and components that they have together, at most.
BLOCK, COMPONENTS = 4096, 1 << 18
#: Bits of one limb of a sum as Spark adds it up.
LIMB = 32
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Codebooks:
    """For each part the integer components of its entries; ``bounds`` are the places where parts begin, and the length of a vector."""

    bounds: list[int]
    entries: list[list[list[int]]]
    scale: int = SCALE

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, joined by commas."""
        numbers = [str(x) for part in self.entries for entry in part for x in entry]
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly, for any finite x."""
    top, bottom = x.as_integer_ratio()
    return scale * top // bottom


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of 64-bit floats: 64-bit integers where they hold all of them, else Python's."""
    if scale & (scale - 1) == 0 and np.abs(values).max(initial=0) * scale < 1 << 62:
        return np.floor(values * scale).astype(np.int64)  # a power of two scales without rounding
    made = np.array([whole(x, scale) for x in values.ravel().tolist()], object).reshape(values.shape)
    return made.astype(np.int64) if max(map(abs, made.ravel().tolist()), default=0) < 1 << 62 else made


def packed(values: np.ndarray) -> tuple[str, bytes]:
    """Integers as bytes, as narrow as they all allow, and the type to read them with; beyond 64 bits as decimals."""
    if values.dtype == object:
        return "text", ",".join(map(str, values.ravel().tolist())).encode()
    most = int(np.abs(values).max(initial=0))
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return kind, values.astype(kind).tobytes()


def unpacked(kind: str, raw: bytes, dims: int, n: int) -> np.ndarray:
    if kind == "text":
        return np.array([int(x) for x in raw.decode().split(",")], object).reshape(n, dims)
    return np.frombuffer(raw, kind).astype(np.int64).reshape(n, dims)


def nearest(vectors: np.ndarray, entries: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """For each row the entry at the least squared distance, lower ones first, and that distance."""
    n, dims = vectors.shape
    most = max([int(abs(x)) for e in entries for x in e] + [int(np.abs(vectors).max(initial=0))], default=0)
    if max(dims, 1) * 4 * most * most < 1 << 53:  # then 64-bit floats hold all sums of products
        v, c = vectors.astype(float), np.array(entries, float).reshape(len(entries), dims)
        squared = (v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None]
        chosen = squared.argmin(1)
        return chosen, squared[np.arange(n), chosen].astype(np.int64)
    v, c = vectors.astype(object), np.array(entries, object).reshape(len(entries), dims)
    squared = np.stack([((v - e) ** 2).sum(1) for e in c], 1)
    chosen = np.array([min(range(len(c)), key=row.__getitem__) for row in squared.tolist()], np.int64)
    return chosen, squared[np.arange(n), chosen]


def assigned(vectors: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the entry of each part, and the squared distances summed over parts."""
    codes, total = np.zeros((len(vectors), len(books.entries)), np.uint8), 0
    for p, entries in enumerate(books.entries):
        codes[:, p], distances = nearest(vectors[:, books.bounds[p] : books.bounds[p + 1]], entries)
        total = distances if p == 0 else total.astype(object) + distances
    return codes, total


def contributions(vectors: np.ndarray, before: np.ndarray | None, after: np.ndarray, bounds: list[int], entries: int) -> Iterator[tuple[int, int, int, int]]:
    """(part, entry, position, amount), what the changed parts take from and add to the sums; position -1 is the count. Without ``before`` all parts are new."""
    for p in range(after.shape[1]):
        moved = np.arange(len(after)) if before is None else np.flatnonzero(before[:, p] != after[:, p])
        if not len(moved):
            continue
        own = vectors[moved, bounds[p] : bounds[p + 1]]
        sums, counts = np.zeros((entries, own.shape[1]), own.dtype if _addable(own) else object), np.zeros(entries, np.int64)
        for codes, sign in [(after, 1)] + ([(before, -1)] if before is not None else []):
            np.add.at(sums, codes[moved, p], sign * own)
            np.add.at(counts, codes[moved, p], sign)
        for e in range(entries):
            amounts = [int(counts[e]), *map(int, sums[e].tolist())]
            yield from ((p, e, k - 1, x) for k, x in enumerate(amounts) if x)


def _addable(values: np.ndarray) -> bool:
    return values.dtype != object and int(np.abs(values).max(initial=0)) * max(len(values), 1) * 2 < 1 << 62


def limbs(x: int) -> Iterator[tuple[int, int]]:
    """A number as (place, limb), the sum of limb << LIMB * place; each limb fits many times into 64 bits."""
    sign, x, place = (1, x, 0) if x >= 0 else (-1, -x, 0)
    while x:
        if low := x & (1 << LIMB) - 1:
            yield place, sign * low
        x >>= LIMB
        place += 1


def usable(vectors: DataFrame, vector: str = "embedding", id_column: str = "vec_id", label: str = "label") -> DataFrame:
    """(vec_id, label, v array<double>) without the rows whose vector is null or holds a null or non-finite component."""
    own = taken(vectors, vec_id=id_column, label=label, embedding=vector)
    own = own.select(F.col("vec_id").cast("long"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.where(F.col("v").isNotNull()).where(F.coalesce(finite, F.lit(False)))


def initial(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> Codebooks:
    """The parts of the first rows by id (then by vector; rows without an id last). Vectors have the length of the very first."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = kept.orderBy(*order).limit(1).collect()
    dims = len(first[0].v) if first else 0
    chosen = kept.where(F.size("v") == dims).orderBy(*order).limit(entries).collect()
    bounds = [dims * p // parts for p in range(parts + 1)]
    rows = [[whole(x, scale) for x in r.v] for r in chosen]
    return Codebooks(bounds, [[r[bounds[p] : bounds[p + 1]] for r in rows] for p in range(parts)], scale)


def _packing(scale: int, dims: int):
    most = max(1, min(BLOCK, COMPONENTS // max(dims, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), most):
                part = batch.slice(i, most)
                values = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(part), dims)
                kind, raw = packed(integers(values, scale))
                columns = [pa.array([uuid.uuid4().hex]), pa.array([len(part)], pa.int32()), pa.array([kind]), pa.array([raw], pa.binary())]
                columns += [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(k)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "n", "kind", "vectors", "ids", "labels"])

    return run


def blocks(kept: DataFrame, books: Codebooks) -> DataFrame:
    """(block, n, kind, vectors, ids, labels): the vectors of the codebooks' length in blocks, bucketed by block."""
    dims, label = books.bounds[-1], kept.schema["label"].dataType.simpleString()
    made = kept.where(F.size("v") == dims).select("vec_id", "label", "v").mapInArrow(_packing(books.scale, dims), f"block string, n int, kind string, vectors binary, ids array<bigint>, labels array<{label}>")
    return cut_bucketed(made, "vectors", ["block"], bucket_count(kept))


def _assigning(books: Codebooks, entries: int):
    dims = books.bounds[-1]
    change = pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("position", pa.int32()), ("place", pa.int32()), ("amount", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, n, kind, raw, old in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                vectors = unpacked(kind, raw, dims, n)
                codes, _ = assigned(vectors, books)
                before = None if old is None else np.frombuffer(old, np.uint8).reshape(n, -1)
                changes = [
                    {"part": p, "entry": e, "position": k, "place": place, "amount": limb}
                    for p, e, k, x in contributions(vectors, before, codes, books.bounds, entries)
                    for place, limb in limbs(x)
                ]
                columns = [pa.array([block]), pa.array([codes.tobytes()], pa.binary()), pa.array([changes], pa.list_(change))]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "codes", "changes"])

    return run


def fit(held: DataFrame, books: Codebooks, rounds: int = ROUNDS) -> Codebooks:
    """Lloyd's rounds over the vectors of ``blocks``, from the entries of ``books``; entries that no part is assigned to stay as they are."""
    many = max(len(e) for e in books.entries)
    if not many:
        return books
    widths = [b - a for a, b in zip(books.bounds, books.bounds[1:], strict=False)]
    sums = [[[0] * (w + 1) for _ in range(many)] for w in widths]  # of each entry: its count, then its components
    codes = None
    for _ in range(rounds):
        vectors = held.select("block", "n", "kind", "vectors")
        both = vectors.join(codes, "block") if codes is not None else vectors.withColumn("codes", F.lit(None).cast("binary"))
        schema = "block string, codes binary, changes array<struct<part int, entry int, position int, place int, amount bigint>>"
        state = cut_bucketed(both.mapInArrow(_assigning(books, many), schema), "codes", ["block"], _buckets(held))
        changes = state.select(F.explode("changes").alias("c")).select("c.*")
        changed = changes.groupBy("part", "entry", "position", "place").agg(F.sum("amount").alias("amount")).collect()
        for c in changed:
            sums[c.part][c.entry][c.position + 1] += c.amount << LIMB * c.place
        codes = state.select("block", "codes")
        entries = [[[x // own[0] for x in own[1:]] if own[0] else entry for entry, own in zip(part, totals, strict=True)] for part, totals in zip(books.entries, sums, strict=True)]
        if entries == books.entries:
            break  # with the same entries no later round changes anything
        books = Codebooks(books.bounds, entries, books.scale)
    return books


def _buckets(table: DataFrame) -> int:
    """How many buckets a table that ``cut_bucketed`` wrote has."""
    spec = table._jdf.queryExecution().analyzed().collectLeaves().head().catalogTable().get().bucketSpec().get()
    return spec.numBuckets()


def _encoding(books: Codebooks):
    dims = books.bounds[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (n, kind, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                codes, errors = assigned(unpacked(kind, raw, dims, n), books)
                error = pa.array([min(int(x), _LONG) for x in errors.tolist()], pa.int64())
                columns = [batch.column(3).slice(k, 1).flatten(), batch.column(4).slice(k, 1).flatten(), pa.array([c.tobytes().hex() for c in codes], pa.string()), error]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    return run


def encode(held: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) for each vector of ``blocks``: two hex digits for each part's entry, and the squared distance to the entries."""
    label = held.schema["labels"].dataType.elementType.simpleString()
    return held.select("n", "kind", "vectors", "ids", "labels").mapInArrow(_encoding(books), f"vec_id bigint, label {label}, code string, error bigint")


def product_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each usable vector, by codebooks fitted on all of them.

    Vectors that are null or hold null or non-finite components are left out, and so are those whose length isn't that of the first vector by id: no
    part of theirs has a codebook. A length that the parts don't divide is cut at floor(length * p / parts). Rows without an id have codes and come last as
    first entries; repeated rows each count. With fewer rows than entries there are as many entries as rows; without rows there is no result. An error or a
    sum of errors beyond 64 bits is given as the largest that they hold. ``entries`` is 256 at most.
    """
    kept = usable(vectors)
    books = initial(kept, parts, entries, scale)
    held = blocks(kept, books)
    books = fit(held, books, rounds)
    coded = encode(held, books)
    coded = cut(coded.withColumn("salt", salt("code", "vec_id")), "codes")
    total = F.least(F.sum("error"), F.lit(_LONG).cast("decimal(38,0)")).cast("long").alias("label_error")
    totals = share_totals(coded, ["label"], [F.sum(F.col("error").cast("decimal(38,0)")).cast("decimal(38,0)").alias("error")], [total])
    totals = totals.withColumnsRenamed({"label": "of", "salt": "share"})
    told = coded.join(totals, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("share")))
    return told.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
