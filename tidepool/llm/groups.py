"""Totals of groups, brought back to their rows without gathering a group.

Rows of a group are dealt over ``SALTS`` shares by a hash. Each share is reduced on its own, the shares of a group are reduced to its total, and the total
goes back to the shares, then to the rows of each: no join has more than one share of a group under one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.scratch import cut

#: Shares of a group.
SALTS = 64


def salt(*columns: str, salts: int = SALTS) -> Column:
    """The share of a row, from columns in which the rows of a group differ."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts))


def share_totals(rows: DataFrame, keys: list[str], share: list[Column], total: list[Column], where: str | None = None) -> DataFrame:
    """(keys, salt, totals) for rows with a ``salt``: ``share`` reduces the rows of a share, ``total`` the shares of a group; ``where`` chooses groups."""
    shares = cut(rows.groupBy(*keys, "salt").agg(*share), "shares")
    totals = shares.groupBy(*keys).agg(*total)
    totals = totals.where(where) if where else totals
    renamed = totals.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    made = [c for c in totals.columns if c not in keys]
    return cut(shares.select(*keys, "salt").join(renamed, same).select(*keys, "salt", *made), "totals")
