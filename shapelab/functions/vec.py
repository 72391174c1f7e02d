"""Vector expressions over arrays of doubles; all stay Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l1(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def chi2(a: Column, b: Column) -> Column:
    """Sum of (x - y)^2 / (x + y); places where both are 0 count nothing."""
    def term(x: Column, y: Column) -> Column:
        x, y = x.cast("double"), y.cast("double")
        return F.when(x + y != 0, (x - y) * (x - y) / (x + y)).otherwise(0.0)

    return _sum(F.zip_with(a, b, term))


def cross(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(a: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2])
