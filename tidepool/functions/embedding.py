"""Embedding texts: the protocol, and a deterministic stand-in by feature hashing."""

from __future__ import annotations

import zlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tidepool.functions.text import column

DOCUMENT, QUERY = "search_document: ", "search_query: "


class Embedder(Protocol):
    def column(self, text: str | Column, task: str = DOCUMENT) -> Column:
        """Vectors of a text column, in Arrow batches."""

    def vector(self, text: str, task: str = QUERY) -> list[float]:
        """The vector of one text on the driver, for a query."""


def bookends(words: list[str], most: int) -> list[str]:
    """The first and last halves of what is too long."""
    return words if len(words) <= most else words[: most // 2] + words[len(words) - (most - most // 2) :]


class HashEmbedder:
    """Each word adds 1 or -1 to one of ``size`` places; the sum is scaled to length 1. Task prefixes change nothing."""

    def __init__(self, size: int = 64, most_words: int = 2048):
        self.size, self.most_words = size, most_words

    def vector(self, text: str, task: str = QUERY) -> list[float]:
        out = np.zeros(self.size)
        for word in bookends((text or "").lower().split(), self.most_words):
            h = zlib.crc32(word.strip(".,;:!?").encode())
            out[h % self.size] += 1 if h >> 31 else -1
        length = np.linalg.norm(out)
        return (out / length if length > 1e-8 else out).astype(np.float32).tolist()

    def column(self, text: str | Column, task: str = DOCUMENT) -> Column:
        @F.pandas_udf(ArrayType(FloatType()))
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: self.vector(t, task))

        return run(column(text))
