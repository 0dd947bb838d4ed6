"""Identifiers and hashes."""

from __future__ import annotations

import os
import re
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepool.functions.text import column

SHAPE = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def uuid7(ms: int | None = None, noise: bytes | None = None) -> str:
    """A version 7 identifier: 48 bits of milliseconds, then random bits, so that text order is time order."""
    noise = os.urandom(10) if noise is None else noise
    bits = (int(time.time() * 1000) if ms is None else ms) << 80 | int.from_bytes(noise, "big")
    bits = bits & ~(0xF << 76) | 7 << 76
    bits = bits & ~(3 << 62) | 2 << 62
    text = f"{bits:032x}"
    return "-".join((text[:8], text[8:12], text[12:16], text[16:20], text[20:]))


def is_uuid(text: str) -> bool:
    return re.match(SHAPE, text or "") is not None and len(text) == 36


def uuid_ms(text: str) -> int:
    return int(text.replace("-", "")[:12], 16)


def valid(c: str | Column) -> Column:
    return F.coalesce(column(c).rlike(SHAPE), F.lit(False))


def made_ms(c: str | Column) -> Column:
    """The time in a version 7 identifier."""
    return F.conv(F.substring(F.replace(column(c), F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("long")


def fnv1a64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a32(data: bytes) -> int:
    h = 0x811C9DC5
    for b in data:
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h
