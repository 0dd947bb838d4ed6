"""SimHash fingerprints of word shingles, and the classes of near-equal fingerprints.

Fingerprints that differ in at most ``radius`` of 64 bits are linked. Candidates come from block keys: the bits are parted into
``blocks`` blocks, and two linked fingerprints agree on at least ``blocks - radius`` of them, so they share a key of
that many blocks. Within a key, distances are counted bit-sliced: bit planes are stored vertically, one lane per fingerprint;
carry-save counters add the differing bits of many pairs at once, and a block is abandoned once all its lanes
exceed the radius. Nothing is missed, whatever the size of a key; a key with many fingerprints is dealt over several tasks.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.bytestext import mix as remixed
from tidepool.llm.bytestext import slices, small_batches, utf8
from tidepool.llm.columns import taken
from tidepool.llm.components import connected_components
from tidepool.llm.scratch import cut

#: Fingerprints of one key that one task compares with each other.
TILE = 2048
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(raw: bytes, words: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of ``words`` words, repeats included; of the whole sequence if it is shorter."""
    parts = raw.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - words].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray, step: int = 1 << 14) -> int:
    """A bit is set if it is in over half of the hashes; zero without any."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), step):
        part = hashes[i : i + step].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", id_column: str = "doc_id", words: int = 4, seed: int = 42) -> DataFrame:
    """(id, bits long): the fingerprint of each document as a signed 64-bit number. Null texts count as empty."""
    own = taken(docs, id=id_column, text=text)
    kind = own.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            bits = np.array([fingerprint(shingle_hashes(x.as_py(), words, seed)) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["id", "bits"])

    return small_batches(own).select("id", utf8("text").alias("text")).mapInArrow(run, f"id {kind}, bits long")


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """A row for each bit, the highest of the first word first, of one bit per fingerprint, packed into 64-bit words.

    Fingerprints are 64-bit words, or rows of several.
    """
    words = prints.reshape(len(prints), -1)
    lanes = -(-len(words) // 64) * 64
    padded = np.zeros((lanes, words.shape[1]), ">u8")
    padded[: len(words)] = words
    bits = np.unpackbits(padded.view(np.uint8).reshape(lanes, -1), axis=1)
    return np.packbits(np.ascontiguousarray(bits.T), axis=1).view(np.uint64)


def lanes_within(differing: Iterator[np.ndarray], shape: tuple[int, ...], radius: int, check: int = 8) -> np.ndarray:
    """Lanes in which at most ``radius`` of the planes are set, by carry-save counters as wide as the radius needs."""
    width = radius.bit_length()
    counters = [np.zeros(shape, np.uint64) for _ in range(width)]
    over = np.zeros(shape, np.uint64)
    above = (1 << width) - 1 - radius  # counting starts here, so that exceeding the radius carries out
    for k in range(width):
        if above >> k & 1:
            counters[k] |= _ALL
    for n, carry in enumerate(differing, 1):
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if n % check == 0 and (over == _ALL).all():
            break
    return ~over


def _unpacked(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1)[..., :n].astype(bool)


def links_across(left: np.ndarray, right: np.ndarray, radius: int, queries: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into left, into right) of all fingerprints within the radius."""
    planes = bit_planes(right)
    places = np.arange(63, -1, -1, dtype=np.uint64)
    for start in range(0, len(left), queries):
        part = left[start : start + queries].reshape(len(left[start : start + queries]), -1, 1)
        flips = np.where((part >> places) & np.uint64(1), _ALL, np.uint64(0)).reshape(len(part), -1)
        found = lanes_within((planes[b][None, :] ^ flips[:, b, None] for b in range(len(planes))), (len(part), planes.shape[1]), radius)
        i, j = np.nonzero(_unpacked(found, len(right)))
        yield i + start, j


def links_of_small(prints: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within groups of consecutive rows, all groups at once: each row against the one ``lag`` places on."""
    lag = 1
    rows = np.arange(len(prints))
    while True:
        rows = rows[rows + lag < len(prints)]
        rows = rows[group[rows] == group[rows + lag]]
        if not len(rows):
            return
        for start in range(0, len(rows), 1 << 16):
            part = rows[start : start + (1 << 16)]
            planes = bit_planes(prints[part] ^ prints[part + lag])
            hit = part[_unpacked(lanes_within(iter(planes), planes[0].shape, radius), len(part))]
            yield hit, hit + lag
        lag += 1


class Forest:
    """Union-find: which links join classes that were apart."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def joins(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def key_masks(blocks: int, radius: int) -> list[int]:
    """The bits of each key: every choice of ``blocks - radius`` blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(chosen) for chosen in itertools.combinations(masks, blocks - radius)]


def blocks_for(n: int, radius: int, crowd: int = 64) -> int:
    """The fewest blocks with which n scattered fingerprints would fall into key groups of at most ``crowd``."""
    blocks = radius + 2
    while blocks < radius + 4 and n >> 64 * (blocks - radius) // blocks > crowd:
        blocks += 1
    return blocks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _linking(radius: int, words: int = 1):
    """For rows (key, tile, other, side, word, ...) sorted by the first three: the links that span what each tile task joins.

    A fingerprint is ``words`` 64-bit words; links name it by its first.
    """

    def tile_links(a: np.ndarray, b: np.ndarray | None) -> list[tuple[int, int]]:
        both = a if b is None else np.concatenate([a, b])
        forest, out, shift = Forest(len(both)), [], 0 if b is None else len(a)
        for i, j in links_across(a, a if b is None else b, radius):
            for x, y in zip(i.tolist(), (j + shift).tolist(), strict=True):
                if x != y and forest.joins(x, y):
                    out.append((x, y))
        return [(int(both[x, 0]), int(both[y, 0])) for x, y in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(rows: np.ndarray) -> pa.RecordBatch:
            new = np.any(rows[1:, :3] != rows[:-1, :3], axis=1)
            group = np.concatenate([[0], np.cumsum(new)])
            sizes = np.bincount(group)
            prints = np.ascontiguousarray(rows[:, 4:]).view(np.uint64)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            apart = rows[:, 1] != rows[:, 2]
            small = np.flatnonzero((sizes[group] > 1) & (sizes[group] <= 48) & ~apart)
            pairs: list[tuple[int, int]] = []
            if len(small):
                found = [(small[i], small[j]) for i, j in links_of_small(prints[small], group[small], radius)]
                i = np.concatenate([x[0] for x in found]) if found else np.zeros(0, int)
                j = np.concatenate([x[1] for x in found]) if found else np.zeros(0, int)
                forest = Forest(len(rows))
                order = np.argsort(group[i], kind="stable")
                pairs += [(int(prints[x, 0]), int(prints[y, 0])) for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True) if forest.joins(x, y)]
            first = np.concatenate([[0], np.cumsum(sizes)])
            large = np.unique(group[(sizes[group] > 48) | apart]) if len(group) else []
            for g in large:
                own = slice(first[g], first[g + 1])
                side = rows[own, 3]
                if apart[first[g]]:
                    if (side == 0).any() and (side == 1).any():
                        pairs += tile_links(prints[own][side == 0], prints[own][side == 1])
                else:
                    pairs += tile_links(prints[own], None)
            pairs = sorted(set(pairs))
            columns = [pa.array(np.array([p[k] for p in pairs], np.uint64).view(np.int64)) for k in (0, 1)]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

        for batch in batches:
            rows = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4 + words)])
            held.append(rows)
            if sum(map(len, held)) < 1 << 16:
                continue
            rows = np.concatenate(held)
            last = np.flatnonzero(np.any(rows[:, :3] != rows[-1, :3], axis=1))  # the last group may go on
            end = last[-1] + 1 if len(last) else 0
            if end:
                yield links(rows[:end])
            held = [rows[end:]]
        if held and len(rows := np.concatenate(held)):
            yield links(rows)

    return run


def compared(keyed: DataFrame, radius: int, words: list[str], tile: int = TILE) -> DataFrame:
    """(a, b): for a table (key, *words), links that span the fingerprints within ``radius`` of one another under each key.

    A key with many fingerprints is dealt over a task for each pair of its tiles.
    """
    crowded = keyed.groupBy("key").count().where(F.col("count") > 1).select("key", F.ceil(F.col("count") / tile).cast("long").alias("tiles"))
    dealt = keyed.join(crowded, "key").withColumn("own", F.pmod(F.xxhash64(*words, F.lit(7)), F.col("tiles")))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("with")
    tasks = dealt.select("key", *words, "own", each).select(
        "key",
        F.least("own", "with").alias("tile"),
        F.greatest("own", "with").alias("other"),
        (F.col("own") > F.col("with")).cast("long").alias("side"),
        *words,
    )
    spread = tasks.repartition("key", "tile", "other").sortWithinPartitions("key", "tile", "other")
    return spread.mapInArrow(_linking(radius, len(words)), "a long, b long").distinct()


def near_links(prints: DataFrame, radius: int = 4, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """(a, b): links that span every class of the distinct fingerprints in column ``bits``.

    Each task returns a spanning forest of what it compares, so copies and dense classes never become all their pairs.
    More ``blocks`` make narrower candidate groups and more keys, and the same links: for a radius of 4, 15 keys of 21 bits with 6 blocks, 35 of 27 with 7,
    70 of 32 with 8. None chooses by the number of fingerprints.
    """
    blocks = blocks or blocks_for(prints.count(), radius)
    keys = [F.struct(F.lit(k).alias("mask"), F.col("bits").bitwiseAND(F.lit(_signed(m))).alias("part")) for k, m in enumerate(key_masks(blocks, radius))]
    keyed = prints.select("bits", F.explode(F.array(*keys)).alias("k")).select("bits", F.xxhash64("k.mask", "k.part").alias("key"))
    return compared(keyed, radius, ["bits"], tile)


def near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id", words: int = 4, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """(id, fingerprint string, component_id): each document with its fingerprint and the smallest id it is linked with.

    Links hold through other documents. Equal fingerprints are one class, so a class of copies costs one row. Documents
    without words have fingerprint zero and are linked like others. Null ids are kept, but never name a class unless it has no other.
    Repeated rows stay, texts of any length are read whole, an empty table gives an empty table; columns other than the two named are
    neither read nor returned, whatever their names.
    """
    own = cut(fingerprints(docs, text, id_column, words), "simhash")
    distinct = cut(own.groupBy("bits").agg(F.min("id").alias("least")), "prints")
    roots = connected_components(near_links(distinct.select("bits"), radius, blocks))
    # written, so that large classes and large groups of copies can be split in the joins
    classes = cut(distinct.join(roots, distinct.bits == roots.node, "left").select("bits", "least", F.coalesce("root", "bits").alias("root")), "classes")
    smallest = cut(classes.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    named = cut(classes.join(smallest, "root").select("bits", "component_id"), "named")
    shown = F.lower(F.lpad(F.hex("bits"), 16, "0"))
    return own.join(named, "bits").select(F.col("id").alias(id_column), shown.alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- wide fingerprints, for similarities that 64 bits can't tell


def wide_fingerprint(hashes: np.ndarray, words: int) -> tuple[int, ...]:
    """``words`` times 64 bits from the same hashes: the fingerprint itself, and those of the hashes mixed anew."""
    return tuple(fingerprint(hashes if not k else remixed(hashes ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))) for k in range(words))


def unrelated_within(bits: int, radius: int) -> float:
    """How likely two unrelated fingerprints are within the radius: that of a fair coin's ``bits`` throws. Times the number of texts it must stay far
    below 1, or chains of chance neighbours join most of the corpus."""
    return sum(math.comb(bits, k) for k in range(radius + 1)) / (1 << bits)


def keys_for(n: int, agree: float, miss: float, crowd: int = 16) -> tuple[int, int]:
    """(bits of a key, number of keys) for n fingerprints.

    A key is as wide as leaves about ``crowd`` scattered fingerprints in each of its groups; there are as many keys as let a
    pair whose bits agree with probability ``agree`` share none with probability ``miss``. So no pair becomes less likely to be found as the input grows.
    """
    width = max(4, math.ceil(math.log2(max(n, 1) / crowd)) if n > crowd else 4)
    return width, math.ceil(math.log(miss) / math.log1p(-(agree**width)))


def sampled_keys(prints: np.ndarray, width: int, count: int) -> np.ndarray:
    """For rows of words: ``count`` keys each, every key a number and ``width`` of the bits, chosen by the number."""
    bits = np.unpackbits(prints.astype(">u8").view(np.uint8).reshape(len(prints), -1), axis=1)
    places = np.int64(1) << np.arange(width, dtype=np.int64)
    out = np.empty((len(prints), count), np.int64)
    for k in range(count):
        chosen = np.random.default_rng(k).permutation(bits.shape[1])[:width]
        out[:, k] = bits[:, chosen].astype(np.int64) @ places + (k << width)
    return out


def wide_links(prints: DataFrame, radius: int, agree: float, miss: float = 1e-3, tile: int = TILE) -> DataFrame:
    """(a, b): links, by the first word, of the distinct fingerprints (w0, w1, ...) that share a sampled key and differ in at most ``radius`` bits."""
    width, count = keys_for(prints.count(), agree, miss)
    names = prints.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            keys = sampled_keys(np.column_stack(words).view(np.uint64), width, count)
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, count, dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*names, "keys"])

    keyed = small_batches(prints).mapInArrow(run, ", ".join([*(f"{n} long" for n in names), "keys array<long>"]))
    return compared(keyed.select(F.explode("keys").alias("key"), *names), radius, names, tile)
