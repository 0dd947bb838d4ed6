"""Columns by place, so that no name in a table can clash with another or with the operators' own.

A table may hold ``Text`` beside ``text``, a name with a dot, or a name that an operator uses inside. Operators therefore
take what they need by place, work on numbered columns, and give the old names back at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place(frame: DataFrame, name: str) -> int:
    """Where a column stands: the first of exactly this name, else the first that differs only in case."""
    if name in frame.columns:
        return frame.columns.index(name)
    lowered = [c.lower() for c in frame.columns]
    if name.lower() not in lowered:
        raise ValueError(f"no column {name!r} among {frame.columns}")
    return lowered.index(name.lower())


def numbered(frame: DataFrame) -> DataFrame:
    """``frame`` with its columns named ``c0``, ``c1`` and so on."""
    return frame.toDF(*[f"c{k}" for k in range(len(frame.columns))])


def at(frame: DataFrame, name: str) -> Column:
    """The column of ``numbered(frame)`` that is ``name`` in ``frame``."""
    return F.col(f"c{place(frame, name)}")


def taken(frame: DataFrame, **wanted: str) -> DataFrame:
    """Only the columns wanted, under the names given as keywords."""
    return numbered(frame).select(*[at(frame, name).alias(new) for new, name in wanted.items()])


def kept(frame: DataFrame) -> list[Column]:
    """All columns of ``numbered(frame)``."""
    return [F.col(f"c{k}") for k in range(len(frame.columns))]
