"""Suffix-array dedup: removing every byte that a long repeated string covers.

Two places that share a string of ``length`` bytes also share its *anchor*: the leftmost of the k-grams in it with the least hash.
So each window of ``length`` bytes is filed under the k-gram at its anchor; only k-grams that stand at several places can
hold a repeat. What is around such places is put into an enhanced suffix array, one for each k-gram: the suffixes from the anchor on in
order, with common prefix lengths. A stack scan of the array gives its common-prefix intervals, each of them a string that all members of the
interval share; the members' text to the left of the anchor, again in order, tells how far it can be extended to the left and where
it is left-diverse. That gives the maximal repeats with all their occurrences, and so each window that occurs elsewhere.

Windows never span documents. A text that stands in several documents is handled once, with its number of copies. A k-gram with more than
``CROWD`` different surroundings is not gathered: its windows are counted by hash, block by block, which is exact as well.

Repeated passages of so many words are found in the same way, on texts in which each word is ``CODE`` bytes of its hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.llm.bytestext import SPACE, flat, mix, prefix_sums, runs, slices, small_batches, span_hashes, spans_of, utf8
from tidepool.llm.columns import at, kept, numbered, place, taken
from tidepool.llm.scratch import cut, cut_bucketed

LENGTH, GRAM = 400, 64
#: Words of a passage (over 50), words of its k-grams, and bytes that stand for a word there.
PASSAGE, WORD_GRAM, CODE = 51, 8, 5
#: Different surroundings of one k-gram that one task puts in order.
CROWD = 256
#: Windows that are counted together where a k-gram has more.
BLOCK = 16
#: Windows of one text that are anchored at once; longer texts are taken piece by piece.
PIECE = 1 << 18
_PLACE = np.uint64((1 << 20) - 1)


# ---------------------------------------------------------------- texts as codes of words


def word_codes(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts, each as ``CODE`` bytes of its hash, and where the codes of each text begin."""
    starts, ends = runs(~SPACE[buffer], offsets)
    hashes = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + PIECE, "right")))
        high = int(ends[j - 1])
        if high - low > PIECE:  # one long word
            hashes[i] = int.from_bytes(hashlib.blake2b(buffer[low:high], digest_size=8).digest(), "little")
        else:
            hashes[i:j] = span_hashes(prefix_sums(buffer[low:high]), starts[i:j] - low, ends[i:j] - low)
        i = j
    return hashes.view(np.uint8).reshape(-1, 8)[:, :CODE].ravel(), np.searchsorted(starts, offsets) * CODE


# ---------------------------------------------------------------- anchors of windows


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by running minima of blocks from both ends."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchored(buffer: np.ndarray, firsts: np.ndarray, length: int = LENGTH, gram: int = GRAM, step: int = 1) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (gram hash, context hash, anchor, first window, last window), all places in ``buffer``.

    ``firsts`` are where texts begin, and the end. A run whose windows all stand ``q`` bytes before too, where ``q`` is how far its
    anchor is from the one before of equal hash, is left out: its windows are returned apart, as (first, last) of windows that occur
    at two places of one text, and the earlier place stands for both. Windows and k-grams begin at each ``step``-th byte, as texts do.
    """
    empty = np.zeros(0, np.int64)
    n = (len(buffer) - length) // step + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), empty, empty, empty, empty, empty
    sums = prefix_sums(buffer)
    at = np.arange(0, len(buffer) - gram + 1, step)
    grams = span_hashes(sums, at, at + gram)
    least = sliding_least((grams & ~_PLACE) | at.astype(np.uint64), (length - gram) // step + 1)
    anchor = (least[:n] & _PLACE).astype(np.int64)
    first = np.arange(n) * step
    text = np.searchsorted(firsts, first, "right") - 1
    inside = first + length <= firsts[text + 1]
    change = np.ones(n, bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    low = np.flatnonzero(change & inside)
    if not len(low):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), empty, empty, empty, empty, empty
    stop = np.ones(n, bool)
    stop[:-1] = change[1:] | ~inside[1:]
    high = np.flatnonzero(stop & inside)
    place = anchor[low]
    key = grams[place // step]
    owner = text[low]
    low, high = low * step, high * step
    # windows that stand a period earlier as well
    again = np.zeros(len(low), bool)
    shift = np.zeros(len(low), np.int64)
    shift[1:] = place[1:] - place[:-1]
    again[1:] = (key[1:] == key[:-1]) & (owner[1:] == owner[:-1])
    again &= (shift > 0) & (low - shift >= firsts[owner])
    some = np.flatnonzero(again)
    same = span_hashes(sums, low[some], high[some] + length) == span_hashes(sums, low[some] - shift[some], high[some] + length - shift[some])
    again[some[~same]] = False
    twice = np.flatnonzero(again)
    own_low = np.concatenate([low[twice], low[twice] - shift[twice]])
    own_high = np.concatenate([high[twice], high[twice] - shift[twice]])
    rest = np.flatnonzero(~again)
    low, high, place, key = low[rest], high[rest], place[rest], key[rest]
    context = mix(span_hashes(sums, low, high + length) + (place - low).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return key, context, place, low, high, own_low, own_high


def merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges (both ends included) joined where they meet."""
    if not len(low):
        return low, high
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > reach[:-1] + 1
    last = np.ones(len(low), bool)
    last[:-1] = new[1:]
    return low[new], reach[last]


def anchor_rows(texts: DataFrame, length: int, gram: int, coded: bool = False) -> DataFrame:
    """For a table (k1, k2, copies, text): the runs of ``anchored``, and with null ``gram`` the windows that a text repeats itself. ``coded`` is for ``word_codes`` in place of bytes."""
    names = ["k1", "k2", "copies", "gram", "context", "off", "low", "high"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    step = CODE if coded else 1
    piece = PIECE // step * step

    def one(k1: np.ndarray, k2: np.ndarray, copies: np.ndarray, buffer: np.ndarray, firsts: np.ndarray, base: int) -> pa.RecordBatch:
        key, context, place, low, high, own_low, own_high = anchored(buffer, firsts, length, gram, step)
        text = np.searchsorted(firsts, low, "right") - 1
        start = firsts[text] - base
        own_text = np.searchsorted(firsts, own_low, "right") - 1
        parts = [merged(own_low[own_text == t] // step, own_high[own_text == t] // step) for t in np.unique(own_text)]
        lows = np.concatenate([p[0] for p in parts]) * step if parts else own_low[:0]
        highs = np.concatenate([p[1] for p in parts]) * step if parts else own_low[:0]
        own = np.searchsorted(firsts, lows, "right") - 1
        owner = np.concatenate([text, own])
        none = [None] * len(own)
        columns = [
            pa.array(k1[owner]),
            pa.array(k2[owner]),
            pa.array(copies[owner]),
            pa.concat_arrays([pa.array(key.view(np.int64)), pa.array(none, pa.int64())]),
            pa.concat_arrays([pa.array(context.view(np.int64)), pa.array(none, pa.int64())]),
            pa.array(np.concatenate([place - low, own]).astype(np.int32)),
            pa.array(np.concatenate([low - start, lows - firsts[own] + base])),
            pa.array(np.concatenate([high - start, highs - firsts[own] + base])),
        ]
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, copies = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            buffer, offsets = flat(batch.column(3))
            if coded:
                buffer, offsets = word_codes(buffer, offsets)
            for i, j in spans_of(offsets, PIECE):
                low, high = int(offsets[i]), int(offsets[j])
                if high - low <= 2 * PIECE:
                    yield one(k1[i:j], k2[i:j], copies[i:j], buffer[low:high], offsets[i : j + 1] - low, 0)
                    continue
                for base in range(low, high - length + 1, piece):
                    end = min(high, base + piece + length - step)
                    yield one(k1[i:j], k2[i:j], copies[i:j], buffer[base:end], np.array([0, end - base]), base - low)

    return texts.select("k1", "k2", "copies", "text").mapInArrow(run, "k1 long, k2 long, copies long, gram long, context long, off int, low long, high long")


# ---------------------------------------------------------------- the enhanced suffix array of one k-gram


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def prefix_intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """The common-prefix intervals (length, first, last) of a suffix array, children before parents; ``common[i]`` is for i and i + 1."""
    stack: list[tuple[int, int]] = []
    for right, here in enumerate([*common, -1]):
        first = right
        while stack and stack[-1][0] > here:
            depth, first = stack.pop()
            yield depth, first, right
        if here >= 0 and (not stack or stack[-1][0] < here):
            stack.append((here, first))


def maximal_repeats(contexts: list[bytes], offsets: list[int], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, members): each string of ``left`` bytes before and ``right`` after the anchor that several contexts share, at least ``length`` long.

    ``members`` are all its occurrences; no longer string has the same ones. ``offsets`` say where in each context the anchor is.
    """
    rights = [c[o:] for c, o in zip(contexts, offsets, strict=True)]
    lefts = [c[:o][::-1] for c, o in zip(contexts, offsets, strict=True)]
    array = sorted(range(len(contexts)), key=rights.__getitem__)
    common = [common_prefix(rights[a], rights[b]) for a, b in zip(array, array[1:], strict=False)]
    by_left = sorted(range(len(contexts)), key=lefts.__getitem__)
    left_rank = {x: k for k, x in enumerate(by_left)}
    left_common = [common_prefix(lefts[a], lefts[b]) for a, b in zip(by_left, by_left[1:], strict=False)]
    longest_left = max(left_common, default=0)
    lowest = np.asarray([*left_common, 0], np.int64)
    for right, first, last in prefix_intervals(common):
        if right + longest_left < length:
            continue
        ranks = sorted(left_rank[x] for x in array[first : last + 1])
        # how far neighbours in left order agree: the least of all steps between them
        between = np.minimum.reduceat(lowest, ranks)[:-1].tolist() if len(ranks) > 1 else []
        for left, a, b in prefix_intervals(between):
            if left + right < length:
                continue
            members = [by_left[r] for r in ranks[a : b + 1]]
            if _right_diverse(rights, members, right):
                yield left, right, members


def _right_diverse(rights: list[bytes], members: list[int], right: int) -> bool:
    """Whether the string can't be extended to the right with the same occurrences (then it is told with a longer one)."""
    following = {rights[m][right : right + 1] for m in members}
    return len(following) > 1 or b"" in following


def repeated_windows(contexts: list[bytes], offsets: list[int], copies: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each context the ranges of its windows (by first byte, both ends included) that occur at another place too."""
    out: list[list[tuple[int, int]]] = [[(0, len(c) - length)] if n > 1 else [] for c, n in zip(contexts, copies, strict=True)]
    # a member meets its repeats from the longest right part to the shortest, so one that reaches no further left than before adds nothing
    furthest = [len(c) if n > 1 else -1 for c, n in zip(contexts, copies, strict=True)]
    for left, right, members in maximal_repeats(contexts, offsets, length):
        for m in members:
            if left <= furthest[m]:
                continue
            furthest[m] = left
            low, high = max(offsets[m] - left, 0), min(offsets[m] + right, len(contexts[m])) - length
            if low <= high:
                out[m].append((low, high))
    return out


def _in_groups(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, bytes]] = []
        rows: list[tuple[int, int, int, int]] = []

        def close() -> None:
            if not held:
                return
            found = repeated_windows([x[4] for x in held], [x[3] for x in held], [x[2] for x in held], length)
            for x, ranges in zip(held, found, strict=True):
                if ranges:
                    low, high = merged(*(np.array(r, np.int64) for r in zip(*ranges, strict=True)))
                    rows.extend((x[0], x[1], a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True))
            held.clear()

        def told() -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=["gram", "context", "from", "to"])

        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != x[0]:
                    close()
                if not held or held[-1][1] != x[1]:
                    held.append(x)
            if len(rows) > 10000:
                yield told()
        close()
        yield told()

    return run


# ---------------------------------------------------------------- the operator


def text_keys(text: str | Column) -> list[Column]:
    """Two 64-bit hashes that stand for a text."""
    own = utf8(text)
    return [F.xxhash64(own, F.lit(1)).alias("k1"), F.xxhash64(F.lit(2), own).alias("k2")]


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(k1, k2, copies, text): each different text once, bucketed by its keys."""
    keyed = small_batches(taken(docs, text=text)).select(*text_keys("text"), utf8("text").alias("text"))
    return cut_bucketed(keyed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text")), "texts", ["k1", "k2"])


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, *, coded: bool = False) -> DataFrame:
    """(k1, k2, low, high): windows of ``distinct_texts`` that occur elsewhere, as ranges of their first bytes. Ranges may overlap.

    With ``coded`` all lengths and places are those of the texts' ``word_codes``.

    Texts with copies are repeated as a whole and are not among the rows, but make others' windows repeated.
    """
    rows = cut(anchor_rows(texts, length, gram, coded), "anchors")
    alone = rows.where("gram is null and copies = 1").select("k1", "k2", "low", "high")
    filed = rows.where("gram is not null")
    crowds = filed.groupBy("gram").agg(F.sum("copies").alias("n"), F.min("context").alias("c1"), F.max("context").alias("c2")).where("n > 1")
    crowds = crowds.select("gram", (F.col("c1") == F.col("c2")).alias("equal"))
    shared = cut(filed.join(crowds, "gram"), "shared")
    whole = shared.where("equal and copies = 1").select("k1", "k2", "low", "high")
    mixed = shared.where("not equal")

    kinds = mixed.groupBy("gram", "context").agg(
        F.sum("copies").alias("copies"), F.min("off").alias("off"), F.min(F.struct("k1", "k2", "low", "high")).alias("place")
    )
    kinds = cut(kinds, "kinds")
    sizes = cut(kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")), "sizes")
    wanted = kinds.join(sizes, "gram").select("gram", "context", "copies", "off", "place.*", "kinds")
    spots = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "context", "copies", "off", "low", "high", "kinds")).alias("spots"))
    contexts = cut(texts.join(spots, ["k1", "k2"]).select("text", "spots").mapInArrow(_surroundings(length, coded), "gram long, context long, copies long, off long, bytes binary, kinds long"), "contexts")

    few = contexts.where(F.col("kinds") <= crowd).drop("kinds").repartition("gram").sortWithinPartitions("gram", "context")
    found = few.mapInArrow(_in_groups(length), "gram long, context long, from long, to long")
    many = _crowded_windows(contexts.where(F.col("kinds") > crowd), length, CODE if coded else 1)
    told = found.unionByName(many)
    places = mixed.where("copies = 1").drop("copies").join(told, ["gram", "context"]).select("k1", "k2", (F.col("low") + F.col("from")).alias("low"), (F.col("low") + F.col("to")).alias("high"))
    return alone.union(whole).union(places)


def _surroundings(length: int, coded: bool):
    names = ["gram", "context", "copies", "off", "bytes", "kinds"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buffer, offsets = flat(batch.column(0))
            if coded:
                buffer, offsets = word_codes(buffer, offsets)
            for first, last, spots in zip(offsets.tolist(), offsets[1:].tolist(), batch.column(1), strict=False):
                text = memoryview(buffer[first:last])
                rows = [(s["gram"], s["context"], s["copies"], s["off"], bytes(text[s["low"] : s["high"] + length]), s["kinds"]) for s in spots.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def _crowded_windows(contexts: DataFrame, length: int, step: int) -> DataFrame:
    """As the suffix arrays tell, for k-grams with many surroundings, by counting hashes.

    Windows are taken in blocks of ``BLOCK`` by their distance from the anchor. If all bytes of a block's windows occur at
    another place too, so do all its windows; if the bytes that its windows have in common do not, none of them does. Only windows of
    the blocks in between are counted one by one, together with those of one example of each block that is repeated as a whole.
    """
    rows = contexts.select("gram", "context", "copies", "off", "bytes").mapInArrow(
        _blocks(length, step), "gram long, context long, copies long, from long, to long, whole long, shared long"
    )
    rows = cut(rows, "windows")  # read three times
    shared = rows.groupBy("gram", "shared").agg(F.sum("copies").alias("n")).where("n > 1").select("gram", "shared")
    whole = rows.groupBy("gram", "whole").agg(F.sum("copies").alias("n"), F.min("context").alias("example")).where("n > 1").select("gram", "whole", "example")
    hit = cut(rows.join(shared, ["gram", "shared"]).join(whole, ["gram", "whole"], "left").select("gram", "context", "from", "to", "copies", "example"), "blocks")
    wholly = hit.where("example is not null").select("gram", "context", "from", "to")
    partly = hit.where("example is null or example = context").withColumn("copies", F.when(F.col("example").isNull(), F.col("copies")).otherwise(2))
    spots = partly.groupBy("gram", "context").agg(F.collect_list(F.struct("from", "to", "copies")).alias("spots"))
    single = contexts.select("gram", "context", "off", "bytes").join(spots, ["gram", "context"])
    single = single.select("gram", "context", "off", "bytes", "spots").mapInArrow(_windows(length, step), "gram long, context long, copies long, at long, hash long")
    single = cut(single, "singles")  # read twice
    again = single.groupBy("gram", "hash").agg(F.sum("copies").alias("n")).where("n > 1").select("gram", "hash")
    found = single.join(again, ["gram", "hash"])
    place = Window.partitionBy("gram", "context").orderBy("at")
    islands = found.withColumn("island", F.col("at") - step * F.row_number().over(place)).groupBy("gram", "context", "island")
    return wholly.unionByName(islands.agg(F.min("at").alias("from"), F.max("at").alias("to")).drop("island"))


def _blocks(length: int, step: int):
    """Of each block of windows the hash of all its bytes, and of what its windows have in common."""
    block = BLOCK // step * step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, context, copies, off = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            buffer, offsets = flat(batch.column(4))
            for i in range(len(batch)):
                sums = prefix_sums(buffer[offsets[i] : offsets[i + 1]])
                last = int(offsets[i + 1] - offsets[i]) - length
                number = np.arange((off[i] - last) // block, off[i] // block + 1)  # by the distance from the anchor
                low, high = np.maximum(off[i] - number * block - block + step, 0), np.minimum(off[i] - number * block, last)
                shape = mix((off[i] - low).astype(np.uint64) * np.uint64(1 << 32) + (off[i] - high).astype(np.uint64))
                # the common bytes are those of the whole block even where a context begins or ends within it
                first = off[i] - number * block
                shared = span_hashes(sums, first, first - block + step + length)
                hashes = mix(span_hashes(sums, low, high + length) ^ shape), mix(shared ^ mix(number.astype(np.uint64)))
                n = len(number)
                arrays = np.full(n, gram[i]), np.full(n, context[i]), np.full(n, copies[i]), low, high, *(h.view(np.int64) for h in hashes)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in arrays], names=["gram", "context", "copies", "from", "to", "whole", "shared"])

    return run


def _windows(length: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, context, off, raw, spots in zip(*batch.columns, strict=True):
                sums = prefix_sums(np.frombuffer(raw.as_buffer(), np.uint8))
                parts = spots.as_py()
                at = np.concatenate([np.arange(s["from"], s["to"] + 1, step) for s in parts])
                copies = np.repeat([s["copies"] for s in parts], [(s["to"] - s["from"]) // step + 1 for s in parts])
                hashes = mix(span_hashes(sums, at, at + length) ^ mix((off.as_py() - at).astype(np.uint64)))
                n = len(at)
                columns = [pa.array(np.full(n, gram.as_py())), pa.array(np.full(n, context.as_py())), pa.array(copies.astype(np.int64)), pa.array(at), pa.array(hashes.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "context", "copies", "at", "hash"])

    return run


def _words_within(lows: np.ndarray, highs: np.ndarray, passage: int) -> int:
    """Words that windows of ``word_codes`` cover, given as ranges of their first bytes; only windows that begin with a word count."""
    first, last = -(-lows // CODE), highs // CODE
    real = first <= last
    starts, ends = merged(first[real], last[real] + passage - 1)
    return int((ends - starts + 1).sum())


def _without(length: int, kept_as: str, passage: int):
    names = ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["n_repeated_words"] * bool(passage), *["kept"] * bool(kept_as)]

    def repeated_words(batch: pa.RecordBatch) -> list[int]:
        buffer, offsets = flat(batch.column(3))
        out = []
        for k, (copies, lows, highs) in enumerate(zip(*(batch.column(c) for c in (2, 6, 7)), strict=True)):
            lows, highs = lows.values, highs.values
            if copies.as_py() > 1:
                n = len(runs(~SPACE[buffer[offsets[k] : offsets[k + 1]]], np.zeros(1, np.int64))[0])
                out.append(n if n >= passage else 0)
            else:
                out.append(_words_within(lows.to_numpy(), highs.to_numpy(), passage) if lows is not None and len(lows) else 0)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            rows = []
            for copies, raw, lows, highs in zip(*(batch.column(k) for k in range(2, 6)), strict=True):
                raw, lows, highs = raw.as_py(), lows.values, highs.values
                if copies.as_py() > 1 and len(raw) >= length:
                    starts, ends = np.array([0]), np.array([len(raw)])
                elif lows is not None and len(lows):
                    starts, ends = merged(lows.to_numpy(), highs.to_numpy() + length - 1)
                    ends = ends + 1
                else:
                    starts = ends = np.zeros(0, np.int64)
                kept = raw
                if len(starts):
                    places = np.concatenate([[0], np.column_stack([starts, ends]).ravel(), [len(raw)]]).tolist()
                    kept = b"".join(raw[a:b] for a, b in zip(places[::2], places[1::2], strict=True))
                rows.append((len(raw), len(raw) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.string()])]
            if passage:
                columns.append(pa.array(repeated_words(batch), pa.int64()))
            if kept_as == "string":
                columns.append(pa.array([r[4].decode("utf-8", "ignore") for r in rows], pa.string()))
            elif kept_as:
                columns.append(pa.array([r[4] for r in rows], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    return run


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, kept_as: str = "", passage: int = 0) -> DataFrame:
    """(k1, k2, n_bytes, n_removed, n_spans, kept_sha256[, n_repeated_words][, kept]) for each different text of ``docs``; ``text_keys`` give the keys.

    Removed is each byte that a string of ``length`` bytes covers which also starts anywhere else in ``docs``, in the same or another
    document; copies of a text are other places. ``kept_as`` is ``binary`` for the bytes that are left, ``string`` for its whole characters. Null texts count as empty; texts shorter than ``length`` lose nothing.
    With ``passage``, ``n_repeated_words`` are the words that a run of so many words covers which also starts anywhere else, whatever its length in bytes and the white space in it; they are told and not removed.
    """
    texts = distinct_texts(docs, text)
    spans = repeated_spans(texts, length, gram)
    if passage:
        words = repeated_spans(texts, passage * CODE, min(WORD_GRAM, passage) * CODE, coded=True)
        spans = spans.withColumn("coded", F.lit(False)).union(words.withColumn("coded", F.lit(True)))
        window, told = F.struct("low", "high"), ["lows", "highs", "word_lows", "word_highs"]
        lists = [F.collect_list(F.when(~F.col("coded"), window)).alias("r"), F.collect_list(F.when(F.col("coded"), window)).alias("w")]
        columns = [F.col(c).alias(name) for c, name in zip(("r.low", "r.high", "w.low", "w.high"), told, strict=True)]
    else:
        told = ["lows", "highs"]
        lists = [F.collect_list(F.struct("low", "high")).alias("r")]
        columns = [F.col("r.low").alias("lows"), F.col("r.high").alias("highs")]
    ranges = spans.distinct().groupBy("k1", "k2").agg(*lists).select("k1", "k2", *columns)
    joined = texts.join(ranges, ["k1", "k2"], "left").select("k1", "k2", "copies", "text", *told)
    schema = "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", n_repeated_words long" if passage else "") + (f", kept {kept_as}" if kept_as else "")
    return joined.mapInArrow(_without(length, kept_as, passage), schema)


def removals(docs: DataFrame, text: str = "text", id_column: str = "doc_id", length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """One row per document: its id, n_bytes, n_removed, n_spans, kept_sha256 and n_repeated_words.

    Repeated rows stay and count as places of their own. Null texts count as empty; texts shorter than ``length`` lose nothing, longer ones of any
    size are taken whole. ``n_repeated_words`` are the words in runs of ``passage`` words that also start anywhere else, of any length in bytes; they are not removed unless
    strings of ``length`` bytes cover them. An empty table gives an empty table. Other columns are neither read nor returned, whatever their names.
    """
    own = taken(docs, id=id_column, text=text)
    found = without_repeats(own, "text", length, passage=passage)
    keyed = own.select("id", *text_keys("text"))
    return keyed.join(found, ["k1", "k2"]).drop("k1", "k2").withColumnRenamed("id", id_column)


def deduplicated(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeats gone from its text, all columns and rows kept, whatever their names; a column ``n_chars`` follows the new text.

    Where a removed run begins or ends within a character, what is left of that character goes too. A null text becomes empty; repeated rows,
    each a place of its own, lose all of a text that is at least ``length`` long. An empty table gives an empty table.
    """
    found = without_repeats(docs, text, length, kept_as="string").select("k1", "k2", "kept")
    own = numbered(docs)
    joined = own.select("*", *text_keys(at(docs, text))).join(found, ["k1", "k2"])
    columns = kept(docs)
    columns[place(docs, text)] = F.col("kept")
    if "n_chars" in docs.columns:
        columns[place(docs, "n_chars")] = F.length("kept").cast(docs.schema[place(docs, "n_chars")].dataType)
    return joined.select(*columns).toDF(*docs.columns)
