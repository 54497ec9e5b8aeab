"""Boxes and number functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_box(box: Column) -> Column:
    """The first four numbers of a box with positive width and height, or null."""
    ok = (F.size(box) >= 4) & (F.get(box, F.lit(2)) > F.get(box, F.lit(0))) & (F.get(box, F.lit(3)) > F.get(box, F.lit(1)))
    return F.when(ok, F.slice(box, 1, 4))


def normal_box(box: Column) -> Column:
    """Four numbers with nulls as 0, or all 0."""
    return F.when(F.size(box) == 4, F.transform(box, lambda x: F.coalesce(x, F.lit(0.0)))).otherwise(F.array(*[F.lit(0.0)] * 4))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length shared by two intervals."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def sigmoid(x: Column, k: float = 1.0) -> Column:
    return 1.0 / (1.0 + F.exp(-k * x))


def rect_key(*edges: Column) -> Column:
    """Edges in tenths, for finding equal boxes."""
    return F.concat_ws(",", *[F.bround(e * 10).cast("long").cast("string") for e in edges])


def array_median(values: Column) -> Column:
    """Median of an array, null if it is empty."""
    s = F.array_sort(values)
    n = F.size(s)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def width_overlap(x0: Column, x1: Column, other_x0: Column, other_x1: Column) -> Column:
    """Shared width of two boxes as a part of the narrower one."""
    shared = F.greatest(F.lit(0.0), F.least(x1, other_x1) - F.greatest(x0, other_x0))
    return shared / F.greatest(F.lit(1.0), F.least(x1 - x0, other_x1 - other_x0))
