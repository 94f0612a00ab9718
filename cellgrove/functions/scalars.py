"""Scalar functions of coordinates and directions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Difference below which two numbers count as equal.
EPSILON = 1e-4


def in_voxels(metres: Column, resolution: float) -> Column:
    """A distance in voxels, rounded up."""
    return F.ceil(metres / F.lit(resolution)).cast("int")


def area_in_voxels(square_metres: Column, resolution: float) -> Column:
    """An area in voxels, rounded up."""
    return F.ceil(square_metres / F.lit(resolution * resolution)).cast("int")


def half_even(x: Column) -> Column:
    """Rounded to a whole number, halves to the even one."""
    return F.bround(x, 0)


def is_diagonal(dr: Column, dc: Column) -> Column:
    return F.abs(dr) + F.abs(dc) == 2


def nearly_equal(a: Column, b: Column) -> Column:
    return F.abs(a - b) < EPSILON


def distance(a: list[Column], b: list[Column]) -> Column:
    """Euclidean distance of two points."""
    total = F.lit(0.0)
    for x, y in zip(a, b):
        total = total + (x - y) * (x - y)
    return F.sqrt(total)


def octile(r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    """Length of the shortest way over pixels in eight directions."""
    dx, dy = F.abs(r1 - r2), F.abs(c1 - c2)
    return F.sqrt(F.lit(2.0)) * F.least(dx, dy) + F.abs(dx - dy)


def pair(a: Column, b: Column) -> Column:
    """An unordered pair of ids."""
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def box_contains(low: list[Column], high: list[Column], p: list[Column]) -> Column:
    """Whether a closed box holds a point."""
    inside = F.lit(True)
    for a, b, x in zip(low, high, p):
        inside = inside & (x >= a) & (x <= b)
    return inside


def boxes_meet(low1: list[Column], high1: list[Column], low2: list[Column], high2: list[Column]) -> Column:
    """Whether two closed boxes have a point in common."""
    meet = F.lit(True)
    for a, b, c, d in zip(low1, high1, low2, high2):
        meet = meet & (a <= d) & (b >= c)
    return meet


def box_distance(low: list[Column], high: list[Column], p: list[Column]) -> Column:
    """Distance of a point to a box, 0 inside."""
    out = [F.greatest(a - x, x - b, F.lit(0.0)) for a, b, x in zip(low, high, p)]
    return F.sqrt(out[0] * out[0] + out[1] * out[1] + out[2] * out[2])
