"""Vectorised work on the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that one vectorised step takes together; longer texts come alone.
CHUNK = 1 << 18
#: Bytes of texts whose results are held in Python together.
SLICE = 1 << 21
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def utf8(column: str | Column) -> Column:
    """A text column as bytes; null counts as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("binary"), F.lit(b"").cast("binary"))


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a binary array without nulls, and where each begins (one more entry than values)."""
    wide = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    kind = np.int64 if wide else np.int32
    _, places, data = array.buffers()
    if not len(array) or places is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    offsets = np.frombuffer(places, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans_of(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of values that have at most ``limit`` bytes together, or one value."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def filled(array: pa.Array) -> pa.Array:
    """A text or binary column with null as empty; anything else as text."""
    if not (pa.types.is_string(array.type) or pa.types.is_large_string(array.type) or pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type)):
        array = array.cast(pa.string())
    return array if not array.null_count else array.fill_null("" if "string" in str(array.type) else b"")


def small_batches(frame: DataFrame) -> DataFrame:
    """``frame``, its session handing rows to Python a few thousand at a time (unless it says how many): texts are long rows."""
    conf = frame.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, str(BATCH_ROWS))
    return frame


def slices(batches: Iterable[pa.RecordBatch], column: int, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``limit`` bytes of a binary column, or one row: what a step makes of a part is given on at once."""
    for batch in batches:
        for i, j in spans_of(flat(filled(batch.columns[column]))[1], limit):
            yield batch.slice(i, j - i)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base modulo 2^64, and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 2 * CHUNK)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            column = np.full(size, base, np.uint64)
            column[0] = 1
            _powers[name] = np.cumprod(column, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all its bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A fixed pseudo-random 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def prefix_sums(buffer: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Prefix sums from which ``span_hashes`` has the hash of any span at once."""
    up, _ = powers(len(buffer) + 1)
    out = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(values[buffer] * up[: len(buffer)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal for spans of equal content, wherever they start."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def runs(mask: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; a run ends where a new text begins (``firsts``)."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.zeros(n, bool)
    before[1:] = mask[:-1]
    firsts = firsts[firsts < n]
    before[firsts] = False
    after = np.zeros(n, bool)
    after[:-1] = mask[1:]
    after[firsts[firsts > 0] - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def table(columns: str) -> np.ndarray:
    """True for the bytes of ``columns`` (latin-1)."""
    out = np.zeros(256, bool)
    out[list(columns.encode("latin-1"))] = True
    return out


#: Bytes that part words: space, and tab to carriage return.
SPACE = table(" \t\n\x0b\x0c\r")
#: Lower case for A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
