"""Column builders over boxes (x1, y1, x2, y2; origin top left, y downwards)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Shared extent over the shorter side; 0 where that is not positive."""
    shorter = F.least(hi1 - lo1, hi2 - lo2)
    return F.when(shorter > 0, F.greatest(F.lit(0.0), F.least(hi1, hi2) - F.greatest(lo1, lo2)) / shorter).otherwise(0.0)


def from_polygon(poly: Column) -> Column:
    """Axis-parallel box of an array of (x, y) points."""
    xs, ys = F.transform(poly, lambda p: p[0]), F.transform(poly, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))
