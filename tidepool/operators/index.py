"""A kept keyword index: postings in blocks with the most that they can weigh, in segments that merge.

Documents are appended as segments and never changed there. A segment has two tables. ``blocks`` are the postings of a term in runs of up to ``BLOCK``: first by how
much a posting can weigh (its band, from document length over term count), then by a hash of the id; each block knows its number of
postings, the largest count, the least ratio of length to count, and the range of hashes. ``documents`` has the tokens of each document. Blocks are dealt over as many files as
their size asks for, in folders by a hash of the term and there by ranges of hashes of ids, so a search opens the folders of its terms and a frequent term fills many files.

A level holds fewer than ``FAN`` segments: as many as that are merged into one of the next level, so n appends leave at most ``FAN - 1`` segments for each digit of n in base ``FAN``. A
document is removed by a tombstone, a row with its segment and terms; nothing is rewritten, and a merge leaves it out. A manifest of one small row for each segment
tells which segments count, and how many documents and tokens are left in each, so a search reads no table of lengths. The last manifest written holds;
there may be one writer at a time.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.functions.constants import BM25_B, BM25_K1, TOP_K
from tidepool.operators import keyword
from tidepool.operators.lineage import written

#: Postings of a block, bytes of tokens that one file of blocks is made of, and folders by hash of the term at most.
BLOCK, FILE_BYTES, MOST_SHARDS = 128, 32 << 20, 4096
#: Bytes that are worth a task of their own where tasks are free.
LEAST_BYTES = 1 << 18
#: Files up to which each is a folder: a term has one posting of a document at most, so one of some hundreds of all.
FEW = 64
#: Segments of a level that are merged into one.
FAN = 3
#: Tokens that are put in order together.
TOKENS = 1 << 19
#: Postings that a query reads before it knows what its k-th score is at least; terms that are named in a filter rather than joined.
SEED, NAMED = 2048, 1000
#: Postings of a term that are read rather than looked up: of 200 blocks or so, a few lookups touch most.
CHEAP = 1 << 15
#: Pairs of query and term from which on queries are scored by ranges of documents, and tokens of a range.
MANY, RANGE_TOKENS = 32, 1 << 22
#: Slack for sums in another order.
SLACK = 1e-7
MANIFEST = "name string, level int, n long, tokens long, shards int, removed array<string>, batch long, covers string"


def shard(term: Column, shards: Column | int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(shards) if isinstance(shards, int) else shards).cast("int")


def dealt(files: int) -> tuple[int, int]:
    """How many folders, and by how many bits of an id's hash each is dealt over files, so that a frequent term fills several."""
    shards = files if files <= FEW else min(MOST_SHARDS, 8 * math.isqrt(files))
    shards = 1 << shards.bit_length() - 1
    return shards, (files // shards).bit_length() - 1


def _moved(places: Column, back: int) -> Column:
    return F.transform(places, lambda x: x - back)


def merges(levels: list[int], fan: int = FAN) -> list[int] | None:
    """Which segments, by their levels, are to be merged into one: the first ``fan`` of the lowest level that has so many; None if there is none."""
    for level in sorted(set(levels)):
        held = [k for k, x in enumerate(levels) if x == level]
        if len(held) >= fan:
            return held[:fan]
    return None


def postings(docs: DataFrame) -> DataFrame:
    """(id, kind, len, term, tf, places) of a table (id, kind, tokens): where each term stands in each document, counted from 0.

    A document's terms are all in its row, so nothing is shuffled: the tokens of many documents are put in order together, one Arrow batch at a time.
    """
    names = ["id", "kind", "len", "term", "tf", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            low = 0
            while low < len(batch):
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + TOKENS, "right")))
                part, low = batch.slice(low, high - low), high
                sizes = part.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                coded = part.column(2).flatten().dictionary_encode()
                code, row = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(part)), sizes)
                place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                order = np.argsort(row * (len(coded.dictionary) + 1) + code, kind="stable")
                code, row, place = code[order], row[order], place[order]
                first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])])) if len(code) else order
                cuts = np.append(first, len(code)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(place.astype(np.int32)))
                columns = [part.column(0).take(pa.array(row[first])), part.column(1).take(pa.array(row[first])), pa.array(sizes[row[first]].astype(np.int32)), coded.dictionary.take(pa.array(code[first])), pa.array(np.diff(cuts)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "kind", "tokens").mapInArrow(run, f"id {kind}, kind int, len int, term string, tf int, places array<int>")


def _raw(values: np.ndarray, cuts: np.ndarray, kind: type) -> pa.Array:
    """Runs of numbers as binary values."""
    kept = np.ascontiguousarray(values, kind)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * kept.itemsize).astype(np.int32)), pa.py_buffer(kept)])


def _numbers(column: pa.Array, kind: type) -> np.ndarray:
    """The numbers of all values of ``_raw``."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", kind, (ends[-1] - ends[0]) // np.dtype(kind).itemsize, ends[0])


def _moved_lists(places: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Lists that lie one after the other, in another order."""
    begins, fresh = (np.cumsum(sizes) - sizes)[order], sizes[order]
    return places[np.repeat(begins - (np.cumsum(fresh) - fresh), fresh) + np.arange(fresh.sum())]


CHUNK = ["term", "part", "ids", "hashes", "kinds", "lens", "tfs", "spots"]


def _chunk_schema(id_type: str) -> str:
    return f"term string, part long, ids array<{id_type}>, hashes binary, kinds binary, lens binary, tfs binary, spots binary"


def _chunks(terms: pa.Array, code: np.ndarray, part: np.ndarray, ids: pa.Array, hashes: np.ndarray, kinds: np.ndarray, lens: np.ndarray, tfs: np.ndarray, spots: np.ndarray) -> pa.RecordBatch:
    """Postings sorted by the code of their term and their part, as one row for each of both."""
    first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (part[1:] != part[:-1])])) if len(code) else code
    cuts = np.append(first, len(code))
    ends = np.append(0, np.cumsum(tfs))[cuts]
    lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), ids)
    columns = [terms.take(pa.array(code[first])), pa.array(part[first]), lists, _raw(hashes, cuts, np.int64), *(_raw(x, cuts, np.int32) for x in (kinds, lens, tfs)), _raw(spots, ends, np.int32)]
    return pa.RecordBatch.from_arrays(columns, names=CHUNK)


def _part(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - ranges)).astype(np.int64) if ranges else np.zeros(len(hashes), np.int64)


def packed(docs: DataFrame, ranges: int) -> DataFrame:
    """What ``postings`` gives, the postings of a term in many documents in one row, for each of 2 ** ``ranges`` ranges of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column(3).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            low = 0
            while low < len(batch):
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + TOKENS, "right")))
                own, low = batch.slice(low, high - low), high
                sizes = own.column(3).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                coded = own.column(3).flatten().dictionary_encode()
                code, row = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(own)), sizes)
                place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                hashes, kinds = own.column(2).to_numpy(zero_copy_only=False), own.column(1).to_numpy(zero_copy_only=False)
                part = _part(hashes, ranges)
                order = np.argsort((code << ranges) | part[row], kind="stable")
                code, row, place = code[order], row[order], place[order]
                first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])])) if len(code) else order
                at = row[first]
                yield _chunks(coded.dictionary, code[first], part[at], own.column(0).take(pa.array(at)), hashes[at], kinds[at], sizes[at], np.diff(np.append(first, len(code))), place)

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "kind", F.xxhash64("id").alias("hash"), "tokens").mapInArrow(run, _chunk_schema(kind))


def repacked(found: DataFrame, ranges: int) -> DataFrame:
    """Postings (id, kind, len, term, tf, places) in the form of ``packed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(4).dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            hashes, kinds, lens, tfs = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3, 5))
            part = _part(hashes, ranges)
            order = np.lexsort((part, code))
            spots = _moved_lists(batch.column(6).flatten().to_numpy(zero_copy_only=False), tfs, order)
            yield _chunks(coded.dictionary, code[order], part[order], batch.column(0).take(pa.array(order)), hashes[order], kinds[order], lens[order], tfs[order], spots)

    kind = found.schema["id"].dataType.simpleString()
    return found.select("id", F.xxhash64("id").alias("hash"), "kind", "len", "term", "tf", "places").mapInArrow(run, _chunk_schema(kind))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, and those of ``packed``) in order of shard and term as blocks, up to ``TOKENS`` postings put in order together.

    A block ends with its term, with what is put in order together, ``BLOCK`` postings, or where a band begins that has a fourth of that. It counts to the band of its first posting.
    """
    names = ["shard", "term", "band", "n", "most_tf", "least_ratio", "low", "high", "ids", "kinds", "lens", "tfs", "places"]
    for batch in batches:
        ends = np.cumsum(batch.column(3).value_lengths().to_numpy(zero_copy_only=False))
        start = 0
        while start < len(batch):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TOKENS, "right")))
            own, start = batch.slice(start, stop - start), stop
            sizes = own.column(3).value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(own)), sizes)
            coded = own.column(1).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
            hashes, kinds, lens, tfs, spots = (_numbers(own.column(k), kind) for k, kind in ((4, np.int64), (5, np.int32), (6, np.int32), (7, np.int32), (8, np.int32)))
            band = np.floor(np.log2(lens / tfs) / 2).astype(np.int32)
            order = np.lexsort((hashes, band, coded))
            spots = _moved_lists(spots, tfs, order)
            coded, band, hashes, kinds, lens, tfs, row = (x[order] for x in (coded, band, hashes, kinds, lens, tfs, row))
            place = np.arange(len(order))
            term_begins = np.concatenate([[True], coded[1:] != coded[:-1]])
            band_begins = np.concatenate([[True], band[1:] != band[:-1]]) | term_begins
            in_term = place - np.maximum.accumulate(np.where(term_begins, place, 0))
            left = np.diff(np.append(np.flatnonzero(band_begins), len(place)))
            worth = np.zeros(len(place), bool)  # bands that are long enough to begin a block
            worth[np.flatnonzero(band_begins)] = left >= BLOCK // 4
            begins = term_begins | worth
            since = place - np.maximum.accumulate(np.where(begins, place, 0))
            first = np.flatnonzero(begins | (since % BLOCK == 0) & (in_term > 0))
            cuts, take = pa.array(np.append(first, len(place)).astype(np.int32)), pa.array(row[first])
            held = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tfs)).astype(np.int32)), pa.array(spots))
            listed = [pa.ListArray.from_arrays(cuts, x) for x in (own.column(3).flatten().take(pa.array(order)), *map(pa.array, (kinds, lens, tfs)), held)]
            columns = [own.column(0).take(take), own.column(1).take(take), pa.array(band[first]), pa.array(np.diff(np.append(first, len(place))).astype(np.int32))]
            columns += [pa.array(np.maximum.reduceat(tfs, first)), pa.array(np.minimum.reduceat(lens / tfs, first)), pa.array(np.minimum.reduceat(hashes, first)), pa.array(np.maximum.reduceat(hashes, first))]
            yield pa.RecordBatch.from_arrays([*columns, *listed], names=names)


def _files(frame: DataFrame) -> int:
    """How many files, by what Spark knows of the size: none far above ``FILE_BYTES``, and two for each free task, unless they are tiny."""
    size = int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(1, math.ceil(size / FILE_BYTES), min(2 * frame.sparkSession.sparkContext.defaultParallelism, math.ceil(size / LEAST_BYTES)))


class KeywordIndex:
    """The index in ``folder``, of documents (id, kind, tokens). An index that was never written is empty."""

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "long"):
        self.spark, self.folder, self.id_type = spark, folder.rstrip("/"), id_type
        self.segments: list[dict] = []
        if (version := self._version()) is not None:
            rows = spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/{version}").collect()
            self.segments = sorted((r.asDict() for r in rows), key=lambda r: (-r["level"], r["name"]))

    # ------------------------------------------------------------ segments

    def _version(self) -> int | None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        system = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in system.listStatus(target)] if system.exists(target) else []
        done = lambda n: system.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest/{n}/_SUCCESS"))
        return next((n for n in sorted((int(n) for n in names if n.isdigit()), reverse=True) if done(n)), None)

    def _commit(self, segments: list[dict], covers: str | None = None) -> None:
        held, covers = self._version(), self.covers if covers is None else covers
        segments = [s | {"covers": covers} for s in segments]
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        rows = self.spark.createDataFrame([tuple(s[n] for n in names) for s in segments], MANIFEST)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/{0 if held is None else held + 1}")
        self.segments = sorted(segments, key=lambda r: (-r["level"], r["name"]))

    def _write(self, documents: DataFrame, found: DataFrame | None = None, **more) -> dict | None:
        """A segment of documents and of their postings, if those aren't at hand; None if there are no documents."""
        name = uuid.uuid4().hex
        path = f"{self.folder}/segments/{name}"
        documents.select("id", "kind", "len", "mark", "tokens").write.parquet(f"{path}/documents")
        kept = self.spark.read.schema(self._document_schema()).parquet(f"{path}/documents")
        totals = kept.agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("tokens")).first()
        if not totals.n:
            return None
        files = _files(kept)
        shards, ranges = dealt(files)
        found = packed(kept, ranges) if found is None else repacked(found, ranges)
        spread = found.select(shard(F.col("term"), shards).alias("shard"), *CHUNK)
        spread = spread.repartitionById(shards << ranges, (F.col("shard") * (1 << ranges) + F.col("part")).cast("int")) if files > 1 else spread.coalesce(1)
        schema = f"shard int, term string, band int, n int, most_tf int, least_ratio double, low long, high long, ids array<{self.id_type}>, kinds array<int>, lens array<int>, tfs array<int>, places array<array<int>>"
        spread.sortWithinPartitions("shard", "term").mapInArrow(_blocks, schema).write.partitionBy("shard").parquet(f"{path}/blocks")
        return {"name": name, "n": totals.n, "tokens": totals.tokens or 0, "shards": shards, "removed": [], "batch": -1} | more

    def append(self, docs: DataFrame, batch: int = -1, covers: str | None = None) -> None:
        """Index a table (id, kind, tokens) as a new segment, and merge segments while a level has too many.

        A ``batch`` number from 0 on that isn't above all that were appended is left out: what a stream runs again is there already. ``covers`` is kept for the caller, if there are
        documents. Ids that the index has already are there twice until they are removed.
        """
        if batch >= 0 and batch <= max([s["batch"] for s in self.segments], default=-1):
            return
        own = docs.select("id", F.col("kind").cast("int").alias("kind"), "tokens")
        documents = own.withColumns({"tokens": F.coalesce("tokens", F.array().cast("array<string>")), "mark": F.xxhash64("tokens")})
        made = self._write(documents.withColumn("len", F.size("tokens")), level=0, batch=batch)
        if made or covers is not None:
            self._commit([*self.segments, *([made] if made else [])], covers)
        while chosen := merges([s["level"] for s in self.segments]):
            self._merge([self.segments[k] for k in chosen])

    def _merge(self, chosen: list[dict]) -> None:
        """One segment of the next level in place of those, without what was removed from them."""
        found = self._opened(self._read(chosen, "blocks", self._block_schema()), chosen)
        documents = self._without(self._read(chosen, "documents", self._document_schema()), chosen)
        rest = [s for s in self.segments if s not in chosen]
        made = self._write(documents, found, level=chosen[0]["level"] + 1, batch=max(s["batch"] for s in chosen))
        self._commit([*rest, made] if made else rest)

    def remove(self, ids: DataFrame) -> int:
        """Remove the documents of a table (id, kind): tombstones are written, no segment is. Gives how many were there."""
        if not self.segments:
            return 0
        name = uuid.uuid4().hex
        path = f"{self.folder}/tombstones/{name}"
        there = self.documents().join(ids.select("id", "kind").distinct(), ["id", "kind"], "left_semi")
        there.select("segment", "id", "kind", "len", F.array_distinct("tokens").alias("terms")).write.parquet(path)
        gone = {r.segment: r for r in self.spark.read.parquet(path).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("tokens")).collect()}
        if not gone:
            return 0
        minus = lambda s: s | {"n": s["n"] - gone[s["name"]].n, "tokens": s["tokens"] - gone[s["name"]].tokens, "removed": [*s["removed"], name]}
        self._commit([minus(s) if s["name"] in gone else s for s in self.segments])
        return sum(r.n for r in gone.values())

    def sync(self, docs: DataFrame, kind: int, covers: str | None = None) -> None:
        """Make the index hold just these documents (id, tokens) of a kind: only those that are new or whose tokens changed are written, those gone are removed."""
        want = docs.select("id", F.lit(kind).alias("kind"), "tokens").withColumn("mark", F.xxhash64("tokens"))
        have = written(self.documents().where(F.col("kind") == kind).select("id", "kind", "mark"), "known")
        self.remove(have.join(want.select("id", "kind", "mark"), ["id", "kind", "mark"], "left_anti"))
        self.append(written(want.join(have, ["id", "kind", "mark"], "left_anti").drop("mark"), "fresh"), covers=covers)

    @property
    def covers(self) -> str:
        """What the last append gave that gave any."""
        return self.segments[0]["covers"] if self.segments else ""

    # ------------------------------------------------------------ reading

    def _document_schema(self) -> str:
        return f"id {self.id_type}, kind int, len int, mark long, tokens array<string>"

    def _block_schema(self) -> str:
        return f"term string, band int, n int, most_tf int, least_ratio double, low long, high long, ids array<{self.id_type}>, kinds array<int>, lens array<int>, tfs array<int>, places array<array<int>>, shard int"

    def _read(self, segments: list[dict], table: str, schema: str) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], f"{schema}, segment string")
        reader = self.spark.read.schema(schema)
        return reduce(DataFrame.unionByName, [reader.parquet(f"{self.folder}/segments/{s['name']}/{table}").withColumn("segment", F.lit(s["name"])) for s in segments])

    def _tombstones(self, segments: list[dict]) -> DataFrame | None:
        names = sorted({n for s in segments for n in s["removed"]})
        if not names:
            return None
        held = self.spark.read.schema(f"segment string, id {self.id_type}, kind int, len int, terms array<string>").parquet(*[f"{self.folder}/tombstones/{n}" for n in names])
        return held.where(F.col("segment").isin([s["name"] for s in segments]))

    def _without(self, rows: DataFrame, segments: list[dict]) -> DataFrame:
        gone = self._tombstones(segments)
        return rows if gone is None else rows.join(gone.select("segment", "id", "kind"), ["segment", "id", "kind"], "left_anti")

    def _opened(self, blocks: DataFrame, segments: list[dict], places: bool = True) -> DataFrame:
        """Blocks as postings, without those removed; columns of the blocks other than lists stay."""
        lists = ["ids", "kinds", "lens", "tfs", *(["places"] if places else [])]
        kept = [c for c in blocks.columns if c not in ("ids", "kinds", "lens", "tfs", "places", "n", "most_tf", "least_ratio", "low", "high", "shard")]
        each = blocks.select(*kept, F.explode(F.arrays_zip(*lists)).alias("p"))
        names = {"ids": "id", "kinds": "kind", "lens": "len", "tfs": "tf", "places": "places"}
        return self._without(each.select(*kept, *[F.col(f"p.{c}").alias(names[c]) for c in lists]), segments)

    def documents(self) -> DataFrame:
        """(segment, id, kind, len, mark, tokens): every document."""
        return self._without(self._read(self.segments, "documents", self._document_schema()), self.segments)

    def _blocks_of(self, terms: list[str] | None) -> DataFrame:
        """The blocks of these terms, or of all; only their folders are opened."""
        if terms is None:
            return self._read(self.segments, "blocks", self._block_schema())
        if not terms or not self.segments:
            return self._read([], "blocks", self._block_schema())
        sizes = sorted({s["shards"] for s in self.segments})
        asked = self.spark.createDataFrame([(t,) for t in terms], "term string")
        folders = {n: [r.s for r in asked.select(shard(F.col("term"), n).alias("s")).distinct().collect()] for n in sizes}
        of = lambda s: self._read([s], "blocks", self._block_schema()).where(F.col("shard").isin(folders[s["shards"]]) & F.col("term").isin(terms))
        return reduce(DataFrame.unionByName, [of(s) for s in self.segments])

    def _asked(self, asked: DataFrame) -> DataFrame:
        """The blocks of the terms of a table; only their folders are opened if they are few."""
        terms = [r.term for r in asked.select("term").distinct().limit(NAMED + 1).collect()]
        if len(terms) <= NAMED:
            return self._blocks_of(terms)
        return self._blocks_of(None).join(asked.select("term").distinct(), "term", "left_semi")

    def _less_removed(self, frequency: DataFrame) -> DataFrame:
        """(term, m) without the documents that were removed."""
        gone = self._tombstones(self.segments)
        if gone is None:
            return frequency
        less = gone.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("less"))
        return frequency.join(less, "term", "left").select("term", (F.col("m") - F.coalesce("less", F.lit(0))).alias("m"))

    def _frequency(self, asked: DataFrame) -> DataFrame:
        """(term, m): how many documents have each term of a table."""
        return self._less_removed(self._asked(asked).groupBy("term").agg(F.sum("n").alias("m")))

    def all_postings(self) -> DataFrame:
        """(segment, term, band, id, kind, len, tf, places)."""
        return self._opened(self._blocks_of(None), self.segments)

    def postings(self, terms: list[str]) -> DataFrame:
        """The postings of these terms; only their folders are opened."""
        return self._opened(self._blocks_of(sorted(set(terms))), self.segments)

    def stats(self) -> tuple[int, float | None]:
        """How many documents there are, and their average length; the manifest tells."""
        n = sum(s["n"] for s in self.segments)
        return n, sum(s["tokens"] for s in self.segments) / n if n else None

    def _corpus(self, n: str = "n", average: str = "average") -> DataFrame:
        return self.spark.createDataFrame([self.stats()], f"{n} long, {average} double")

    # ------------------------------------------------------------ searches

    def search(self, query: str, tier: str = "tiered", stemmed: bool = False) -> DataFrame:
        """(id, kind, score) of the matching documents, as ``keyword.search`` finds and scores them."""
        phrases, strict = keyword.asked(query, stemmed)
        terms = sorted({t for p in phrases for t in p})
        if not phrases:
            return self.documents().select("id", "kind", F.lit(0.0).alias("score")).where(F.lit(False))
        column = {t: f"_p{k}" for k, t in enumerate(terms)}
        held = self.postings(terms).groupBy("segment", "id", "kind", "len").agg(*[F.max(F.when(F.col("term") == t, F.col("places"))).alias(c) for t, c in column.items()])

        def count(phrase: list[str]) -> Column:
            begins = F.col(column[phrase[0]])
            for k, t in enumerate(phrase[1:], 1):
                begins = F.array_intersect(begins, _moved(F.col(column[t]), k))
            return F.coalesce(F.greatest(F.size(begins), F.lit(0)), F.lit(0))

        counted = held.select("id", "kind", F.col("len").alias("_len"), *[count(p).alias(f"_f{k}") for k, p in enumerate(phrases)])
        return keyword.chosen(counted, self._corpus("_n", "_avg"), strict, tier)

    def search_batch(self, queries: DataFrame, k: int = TOP_K, digits: int = 9) -> DataFrame:
        """(query_id, rank, id, score): the k best of each query of a table (query_id, term), by any of its terms. See ``Batch``, and ``by_ranges`` for many queries."""
        asked = written(queries.select("query_id", "term").dropDuplicates(), "asked")
        if asked.limit(MANY).count() < MANY:
            return Batch(self, asked, k, digits).best
        return by_ranges(self, asked, k, digits)


class Batch:
    """A batch of queries by any of their terms, with the k best of each.

    A term's postings of one band of one segment are a layer. What a layer's postings can weigh at most is known from its blocks. A few postings of the layers that can weigh most give a score that
    the k-th reaches at least. Layers by rising weight don't count as long as a document that is only in them can't reach that; all others are read whole. Documents found there
    that can still be among the best are looked up in the blocks of other layers that hold their hash; no other block is read. Terms of up to ``CHEAP`` postings are read whole, and
    where there are no others nothing is judged. ``best`` is what scoring all postings gives.

    ``read`` is (query_id, term, read, n): how many postings of a term a query read, and how many there are.
    """

    def __init__(self, index: KeywordIndex, queries: DataFrame, k: int, digits: int):
        self.index = index
        asked = written(queries.select("query_id", "term").dropDuplicates(), "asked")
        blocks = index._asked(asked)
        self.blocks, corpus = blocks, F.broadcast(index._corpus())
        average = F.col("average")
        layers = blocks.groupBy("segment", "term", "band").agg(F.sum("n").cast("long").alias("n"), F.count(F.lit(1)).alias("blocks"), F.max("most_tf").alias("most_tf"), F.min("least_ratio").alias("least_ratio"))
        layers = written(layers, "layers")
        frequency = index._less_removed(layers.groupBy("term").agg(F.sum("n").alias("m")))
        most = (BM25_K1 + 1) / (1 + BM25_K1 * ((1 - BM25_B) / F.col("most_tf") + BM25_B * F.col("least_ratio") / average))
        weights = frequency.crossJoin(corpus).select("term", keyword.idf(F.col("n"), F.col("m")).alias("idf"), "average")
        wide = asked.join(weights, "term").join(layers, "term").withColumn("most", F.col("idf") * most).select("query_id", "term", "segment", "band", "n", "blocks", "idf", "average", "most")
        # by rising weight: the most that a document can score that is in no layer but these, one of each term
        own = Window.partitionBy("query_id", "term").orderBy("most", "segment", "band")
        rise = F.col("most") - F.lag("most", 1, 0.0).over(own)
        whole = Window.partitionBy("query_id")
        rising = whole.orderBy("most", "term", "segment", "band").rowsBetween(Window.unboundedPreceding, 0)
        falling = whole.orderBy(F.desc("most"), "term", "segment", "band").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("n").over(falling), F.lit(0))
        wide = wide.withColumn("rise", rise).withColumn("up_to", F.sum("rise").over(rising)).withColumn("seed", before < SEED).drop("rise")
        wide = wide.withColumn("cheap", F.sum("n").over(Window.partitionBy("query_id", "term")) <= CHEAP)
        self.wide = written(wide, "wide")
        score = F.col("idf") * keyword.term_weight(F.col("tf"), F.col("len"), F.col("average"))
        place = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), "id")
        if self.wide.where("NOT cheap").isEmpty():
            self.judged, self.looked = self.wide.withColumn("counts", F.lit(True)), None
            total = self._postings(self.wide).groupBy("query_id", "segment", "id").agg(F.sum(score).alias("score"))
        else:
            total = self._pruned(score, k)
        self.best = total.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")

    def _pruned(self, score: Column, k: int) -> DataFrame:
        """(query_id, segment, id, score) of every document that can be among the best."""
        # what the k-th scores at least
        seeds = self._postings(self.wide.where("seed")).groupBy("query_id", "segment", "id").agg(F.sum(score).alias("score"))
        floors = written(self._nth(seeds, k), "floors")
        # layers without which one of the best can be missed
        judged = self.wide.join(floors, "query_id", "left").withColumn("counts", F.col("cheap") | (F.col("up_to") >= F.coalesce("floor", F.lit(-1.0)) - SLACK))
        self.judged = written(judged.drop("floor", "seed"), "judged")
        found = self._postings(self.judged.where("counts"))
        found = found.groupBy("query_id", "segment", "id").agg(F.sum(score).alias("score"), F.collect_set("term").alias("terms"))
        found = written(found, "found")
        floors = written(self._nth(found, k), "floors")
        # what the rest can add, for terms that weren't found
        left = self.judged.where("NOT counts").groupBy("query_id", "segment", "term").agg(F.max("most").alias("most"))
        rest = left.groupBy("query_id", "segment").agg(F.collect_list(F.struct("term", "most")).alias("rest"))
        open_docs = found.join(rest, ["query_id", "segment"], "left").join(floors, "query_id", "left")
        missing = F.filter(F.coalesce("rest", F.array().cast("array<struct<term:string,most:double>>")), lambda x: ~F.array_contains("terms", x["term"]))
        open_docs = open_docs.withColumn("missing", missing)
        can = F.col("score") + F.aggregate("missing", F.lit(0.0), lambda total, x: total + x["most"]) >= F.coalesce("floor", F.lit(-1.0)) - SLACK
        open_docs = written(open_docs.where(can).select("query_id", "segment", "id", "score", F.transform("missing", lambda x: x["term"]).alias("missing")), "open")
        self.looked = written(self._lookups(open_docs), "looked")
        more = self._postings_at(self.looked).groupBy("query_id", "segment", "id").agg(F.sum(score).alias("more"))
        return open_docs.join(more, ["query_id", "segment", "id"], "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0)))

    @staticmethod
    def _nth(scores: DataFrame, k: int) -> DataFrame:
        place = Window.partitionBy("query_id").orderBy(F.desc("score"))
        return scores.withColumn("place", F.row_number().over(place)).where(F.col("place") == k).select("query_id", F.col("score").alias("floor"))

    def _postings(self, layers: DataFrame) -> DataFrame:
        """The postings of chosen layers, for each query that chose them."""
        keys = ["segment", "term", "band"]
        chosen = layers.select("query_id", *keys, "idf", "average")
        held = self.blocks.join(chosen.select(*keys).distinct(), keys, "left_semi")
        return self.index._opened(held, self.index.segments, places=False).join(chosen, keys)

    def _lookups(self, docs: DataFrame) -> DataFrame:
        """(query_id, segment, term, band, low, id, hash): the blocks in whose range of hashes a document's hash is, of terms that it may have.

        Hashes are parted into as many ranges as a layer has blocks, or fewer by up to a half; each block is filed under those that it touches, so that the join has a key with few rows.
        """
        keys = ["segment", "term", "band"]
        layers = self.judged.where("NOT counts").select("query_id", *keys, F.floor(F.log2(F.col("blocks").cast("double"))).cast("int").alias("bits"))
        part = lambda h: F.when(F.col("bits") > 0, F.expr(f"shiftrightunsigned({h} ^ {-(1 << 63)}, 64 - bits)")).otherwise(0)
        asked = docs.select("query_id", "segment", "id", F.xxhash64("id").alias("hash"), F.explode("missing").alias("term")).join(layers, ["query_id", "segment", "term"])
        asked = asked.withColumn("part", part("hash"))
        held = self.blocks.select(*keys, "low", "high").join(layers.select(*keys, "bits").distinct(), keys)
        held = held.withColumn("part", F.explode(F.sequence(part("low"), part("high")))).drop("bits")
        both = asked.join(held, [*keys, "part"]).where((F.col("low") <= F.col("hash")) & (F.col("hash") <= F.col("high")))
        return both.select("query_id", *keys, "low", "high", "id", "hash")

    def _postings_at(self, looked: DataFrame) -> DataFrame:
        """The postings of documents in the blocks where they were looked up."""
        keys = ["segment", "term", "band", "low", "high"]
        held = self.blocks.join(looked.select(*keys).distinct(), keys, "left_semi")
        weights = self.judged.select("query_id", "segment", "term", "band", "idf", "average")
        opened = self.index._opened(held, self.index.segments, places=False)
        wanted = looked.select("query_id", "segment", "term", "band", "id").distinct().join(weights, ["query_id", "segment", "term", "band"])
        return opened.join(wanted, ["segment", "term", "band", "id"])

    @property
    def read(self) -> DataFrame:
        layers = self.judged.groupBy("query_id", "term").agg(F.sum(F.when(F.col("counts"), F.col("n")).otherwise(0)).alias("read"), F.sum("n").alias("n"))
        if self.looked is None:
            return layers
        sizes = self.blocks.select("segment", "term", "band", "low", "high", F.col("n").alias("more"))
        probed = self.looked.select("query_id", "segment", "term", "band", "low", "high").distinct().join(sizes, ["segment", "term", "band", "low", "high"])
        probed = probed.groupBy("query_id", "term").agg(F.sum("more").alias("more"))
        return layers.join(probed, ["query_id", "term"], "left").select("query_id", "term", (F.col("read") + F.coalesce("more", F.lit(0))).alias("read"), "n")


# ---------------------------------------------------------------- many queries


def _cut_by_range(ranges: int):
    """Rows (segment, term, hashes, ids, kinds, lens, tfs) of blocks as rows for each term and range of documents, of up to ``TOKENS`` postings that are put in order together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column(3).value_lengths().to_numpy(zero_copy_only=False))
            start = 0
            while start < len(batch):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TOKENS, "right")))
                own, start = batch.slice(start, stop - start), stop
                row = np.repeat(np.arange(len(own)), own.column(3).value_lengths().to_numpy(zero_copy_only=False))
                segment, term = (own.column(k).dictionary_encode() for k in (0, 1))
                both = (segment.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(term.dictionary) + term.indices.to_numpy(zero_copy_only=False))[row]
                part = np.mod(own.column(2).flatten().to_numpy(zero_copy_only=False), ranges)
                code = both * ranges + part
                order = np.argsort(code, kind="stable")
                code = code[order]
                first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                cuts = np.append(first, len(code))
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), own.column(3).flatten().take(pa.array(order)))
                numbers = (_raw(own.column(k).flatten().to_numpy(zero_copy_only=False)[order], cuts, np.int32) for k in (4, 5, 6))
                take = pa.array(row[order[first]])
                yield pa.RecordBatch.from_arrays([pa.array((code[first] % ranges).astype(np.int32)), own.column(0).take(take), own.column(1).take(take), lists, *numbers], names=["part", "segment", "term", "ids", "kinds", "lens", "tfs"])

    return run


class _Range:
    """The postings of one range of documents, and the best documents of sets of terms in it."""

    def __init__(self, chunks: list[pa.RecordBatch], gone: set[tuple], average: float, k: int, digits: int):
        self.k, self.unit = k, 10.0**digits
        column = lambda name: pa.concat_arrays([c.column(name) for c in chunks])
        sizes = np.concatenate([c.column("ids").value_lengths().to_numpy(zero_copy_only=False) for c in chunks])
        kinds, lens, tfs = (np.concatenate([_numbers(c.column(name), np.int32) for c in chunks]) for name in ("kinds", "lens", "tfs"))
        terms, segments, ids = column("term").dictionary_encode(), column("segment").dictionary_encode(), column("ids").flatten().dictionary_encode()
        code, at = (np.repeat(x.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes) for x in (terms, segments))
        ordered = pc.sort_indices(ids.dictionary)
        self.ids, place = ids.dictionary.take(ordered), np.empty(len(ordered), np.int64)
        place[ordered.to_numpy(zero_copy_only=False)] = np.arange(len(ordered))
        doc = place[ids.indices.to_numpy(zero_copy_only=False)]
        if gone:
            names, known = segments.dictionary.to_pylist(), self.ids.to_pylist()
            live = np.array([(names[s], known[d], x) not in gone for s, d, x in zip(at.tolist(), doc.tolist(), kinds.tolist(), strict=True)], bool)
            code, at, doc, lens, tfs = (x[live] for x in (code, at, doc, lens, tfs))
        # documents by id, then by segment
        held, doc = np.unique(doc * len(segments.dictionary) + at, return_inverse=True)
        self.owner = held // max(1, len(segments.dictionary))
        width = -(-max(1, len(held)) // 64) * 64
        both = code * width + doc
        order = np.argsort(both, kind="stable")
        # an id that was appended twice, or is of two kinds, has several postings of a term
        self.single = not (np.diff(both[order]) == 0).any()
        self.doc, self.weight = doc[order].astype(np.int32), keyword.term_weight(tfs[order].astype(float), lens[order].astype(float), average)
        cuts = np.searchsorted(code[order], np.arange(len(terms.dictionary) + 1)).tolist()
        self.cuts = dict(zip(terms.dictionary.to_pylist(), zip(cuts[:-1], cuts[1:], strict=True), strict=True))
        self.score, self.whole = np.zeros(width), {}

    def _add(self, term: str, idf: float) -> None:
        low, high = self.cuts.get(term, (0, 0))
        doc, weight = self.doc[low:high], self.weight[low:high]
        if self.single and high - low <= len(self.score) // 2:
            self.score[doc] += idf * weight
        elif high > low:
            if term not in self.whole:
                self.whole[term] = np.bincount(doc, weight, len(self.score))
            self.score += idf * self.whole[term]

    def best(self, terms: list[str], idfs: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of ids, scores, and scores in units of the last digit that counts: the k best, ties by id."""
        self.score[:] = 0
        for term, idf in zip(terms, idfs, strict=True):
            self._add(term, idf)
        # the k-th of the best of every 64 is at most the k-th best
        tops = self.score.reshape(-1, 64).max(1)
        least = np.partition(tops, -self.k)[-self.k] - 2 / self.unit if len(tops) >= self.k else 0.0
        found = np.flatnonzero(self.score >= least) if least > 0 else np.flatnonzero(self.score)
        told = np.floor(self.score[found] * self.unit + 0.5)
        if len(found) > self.k:
            kth = np.partition(told, -self.k)[-self.k]
            above = np.flatnonzero(told > kth)
            kept = np.concatenate([above, np.flatnonzero(told == kth)[: self.k - len(above)]])
            found, told = found[kept], told[kept]
        return self.owner[found], self.score[found], told


def _best_of_ranges(average: float, k: int, digits: int):
    """Rows in order of part and side: documents that are gone, postings, sets of terms. Sets are streamed past the postings of their range."""
    names = ["set_id", "id", "score", "told"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, gone, chunks, own = None, set(), [], None
        for batch in batches:
            parts, sides = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("part", "side"))
            cuts = np.flatnonzero(np.concatenate([[True], (parts[1:] != parts[:-1]) | (sides[1:] != sides[:-1]), [True]])) if len(batch) else []
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                rows = batch.slice(low, high - low)
                if parts[low] != part:
                    part, gone, chunks, own = parts[low], set(), [], None
                if sides[low] == 0:
                    gone.update(zip(rows.column("segment").to_pylist(), (i[0] for i in rows.column("ids").to_pylist()), rows.column("set_id").to_pylist(), strict=True))
                elif sides[low] == 1:
                    chunks.append(rows)
                elif chunks or own:
                    if own is None:
                        own, chunks = _Range(chunks, gone, average, k, digits), []
                    sets = rows.column("set_id").to_pylist()
                    found = [own.best(t, w) for t, w in zip(rows.column("terms").to_pylist(), rows.column("idfs").to_pylist(), strict=True)]
                    places, scores, told = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(sets, [len(f[0]) for f in found])), own.ids.take(pa.array(places)), pa.array(scores), pa.array(told)], names=names)

    return run


def by_ranges(index: KeywordIndex, asked: DataFrame, k: int, digits: int, tokens: int = RANGE_TOKENS) -> DataFrame:
    """What ``Batch`` finds for a table (query_id, term), where there are many queries: equal sets of terms are one, and the postings of a range of documents, by hash of their id, are scored for one set after the other.

    A posting moves once, to its range; a set of terms moves to every range. No pair of query and document leaves a task but the k best of a range. The work grows with sets times postings.
    """
    n, average = index.stats()
    if not average:
        return Batch(index, asked, k, digits).best
    ranges = max(math.ceil(n * average / tokens), min(2 * index.spark.sparkContext.defaultParallelism, math.ceil(n / 1024)))
    members = written(asked.groupBy("query_id").agg(F.sort_array(F.collect_set("term")).alias("terms")), "members")
    sets = written(members.select("terms").distinct().select(F.monotonically_increasing_id().alias("set_id"), "terms"), "sets")
    blocks, frequency = index._asked(asked), index._frequency(asked)
    weights = frequency.select("term", keyword.idf(F.lit(n), F.col("m")).alias("idf"))
    each = sets.select("set_id", F.explode("terms").alias("term")).join(weights, "term")
    told = written(each.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("t")), "weights")

    id_type = index.id_type
    columns = f"segment string, term string, ids array<{id_type}>, kinds binary, lens binary, tfs binary"
    opened = blocks.select("segment", "term", F.transform("ids", lambda i: F.xxhash64(i)).alias("hashes"), "ids", "kinds", "lens", "tfs")
    chunks = opened.mapInArrow(_cut_by_range(ranges), f"part int, {columns}")
    nothing = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in f"{columns}, set_id long, terms array<string>, idfs array<double>".split(", ")}
    row = lambda frame, side, **more: frame.select("part", F.lit(side).alias("side"), *[more.get(c, e).alias(c) for c, e in nothing.items()])
    own = {c: F.col(c) for c in ("segment", "term", "ids", "kinds", "lens", "tfs")}
    everywhere = told.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))))
    both = row(chunks, 1, **own).unionByName(row(everywhere, 2, set_id=F.col("set_id"), terms=F.col("t.term"), idfs=F.col("t.idf")))
    gone = index._tombstones(index.segments)
    if gone is not None:
        dead = gone.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(ranges)).cast("int"))
        both = both.unionByName(row(dead, 0, segment=F.col("segment"), ids=F.array("id"), set_id=F.col("kind").cast("long")))
    spread = both.repartitionById(ranges, "part").sortWithinPartitions("part", "side")
    found = spread.mapInArrow(_best_of_ranges(average, k, digits), f"set_id long, id {id_type}, score double, told double")
    place = Window.partitionBy("set_id").orderBy(F.desc("told"), "id")
    best = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return members.join(sets, "terms").select("query_id", "set_id").join(best, "set_id").select("query_id", "rank", "id", "score")
