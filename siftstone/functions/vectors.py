"""Vector functions over array columns; arithmetic in double, element by element, so results do not depend on the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, y: acc + y)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def squared_norm(v: Column) -> Column:
    return _sum(F.transform(doubles(v), lambda x: x * x))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def unit(v: Column) -> Column:
    norm = F.sqrt(squared_norm(v))
    return F.transform(doubles(v), lambda x: x / norm)


def well_formed(v: Column, size: int) -> Column:
    """The right size, finite, and not zero."""
    finite = F.forall(doubles(v), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == size) & finite & F.exists(doubles(v), lambda x: x != 0), F.lit(False))


def unit_length(v: Column, tolerance: float = 1e-4) -> Column:
    return F.abs(squared_norm(v) - 1) <= tolerance


def decade(age: Column) -> Column:
    return F.floor(age / 10).cast("int")


def age_group(age: Column) -> Column:
    return F.when(age < 18, "child").when(age < 65, "adult").when(age.isNotNull(), "older adult")
