"""Vector functions on array columns, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    """A vector as a literal, so that a plan needs no join to see it."""
    return F.array(*[F.lit(float(x)) for x in vector])


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def squared(v: Column) -> Column:
    return F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x)


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance; null where the widths differ."""
    return F.sqrt(F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def l2_normalised(v: Column, least: float = 1e-12) -> Column:
    """v over its length, or over `least` where that is larger."""
    norm = F.greatest(F.sqrt(squared(v)), F.lit(least))
    return F.transform(_doubles(v), lambda x: x / norm)
