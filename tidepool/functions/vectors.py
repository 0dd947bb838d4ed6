"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepool.functions.text import column


def dot(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(column(a), column(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: str | Column, b: str | Column) -> Column:
    """1 minus the cosine, not below 0; 1 where a vector is all but zero."""
    size = norm(a) * norm(b)
    return F.when(size < 1e-8, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - dot(a, b) / size))


def l2_distance(a: str | Column, b: str | Column) -> Column:
    squares = F.zip_with(column(a), column(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def normalised(a: str | Column) -> Column:
    """Scaled to length 1; as it is if it is all but zero."""
    size = norm(a)
    return F.when(size > 1e-8, F.transform(column(a), lambda x: x.cast("double") / size)).otherwise(F.transform(column(a), lambda x: x.cast("double")))


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
