"""Byte-level BPE encoding and decoding by a local rank file.

The tiktoken library does the merging. A long text is first parted at places where no match of the pre-splitting
pattern can span: before a space or line end that follows an ASCII letter or digit. Matches are the same on
either side, since none runs from a letter or digit into white space and the pattern looks ahead only past white space.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidepool.llm.bytestext import slices, small_batches, utf8
from tidepool.llm.columns import taken

#: Characters of a text beyond which it is parted.
PART = 1 << 16
_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])")


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The encoding of a rank file: lines of a base64 token and its rank."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut only where no match spans; a stretch without such a place stays whole."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str, rank_file: str, pattern: str) -> list[int]:
    """Ids of the whole text, special tokens' strings being ordinary text."""
    own = encoding(rank_file, pattern)
    if len(text) <= PART:
        return own.encode_ordinary(text)
    return [i for part in safe_parts(text) for i in own.encode_ordinary(part)]


def decode(ids: list[int], rank_file: str, pattern: str) -> bytes:
    """The raw bytes of the ids; they need not be whole characters."""
    return encoding(rank_file, pattern).decode_bytes(ids)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", id_column: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """One row per document: its id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, the ids.

    Null and empty texts have no tokens; bytes that are not UTF-8 are read as U+FFFD. Texts of any length are encoded whole, an empty table gives
    an empty table. Repeated rows stay; columns other than the two named are neither read nor returned, whatever their names.
    """
    own = taken(docs, id=id_column, text=text)
    id_type = own.schema["id"].dataType
    out = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = []
            for raw in batch.column(1):
                ids = encode(raw.as_py().decode("utf-8", "replace"), rank_file, pattern)
                packed = np.asarray(ids, "<u4").tobytes()
                rows.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decode(ids, rank_file, pattern)).hexdigest(), ids))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(out.types)]
            if keep_ids:
                columns.append(pa.array([r[3] for r in rows], pa.list_(pa.int32())))
            names = [id_column, *out.names, *["ids"] * keep_ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    schema = f"`{id_column}` {id_type.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return small_batches(own).select("id", utf8("text").alias("text")).mapInArrow(run, schema)
