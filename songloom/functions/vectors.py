"""Column functions over ``array<float>`` vectors, evaluated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def is_sound(v: Column) -> Column:
    """Neither null nor empty, and every component a finite number."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite, F.lit(False))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y))


def squared_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y)))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def unit(v: Column) -> Column:
    """Vector of length one; a zero vector stays as it is."""
    # the length is bound once, outside the per-element function
    lengths = F.array(F.nullif(norm(v), F.lit(0.0)))
    scaled = F.transform(lengths, lambda n: F.transform(as_doubles(v), lambda x: x / F.coalesce(n, F.lit(1.0))))
    return F.element_at(scaled, 1)


def project(columns: list[str], axes: list[list[float]]) -> list[Column]:
    """Products of a row's columns with constant axes, as plain arithmetic."""

    def along(axis: list[float]) -> Column:
        out = F.lit(0.0)
        for name, weight in zip(columns, axis):
            out = out + F.col(name) * F.lit(float(weight))
        return out

    return [along(axis) for axis in axes]
