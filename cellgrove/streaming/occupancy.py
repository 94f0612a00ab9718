"""Incremental voxelization of a stream of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def point_counts(points: DataFrame, offset: tuple[float, float, float], resolution: float) -> DataFrame:
    """Points per cell of a stream (x, y, z); counts add up, so the result is the same in any order of batches."""
    cell = lambda a, o: ((F.col(a) - o) / resolution).cast("int")
    x, y, z = offset
    return points.groupBy(cell("y", y).alias("i"), cell("x", x).alias("r"), cell("z", z).alias("c")).agg(F.count("*").alias("n"))
