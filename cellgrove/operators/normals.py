"""Normals from occupancy alone: horizontal stacks, vertical segments and their adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellgrove.operators.columns import COLUMN, grown_vertically, in_runs, surface_above
from cellgrove.operators.components import label_components
from cellgrove.operators.neighbours import CELL, neighbour_count, with_neighbours
from cellgrove.operators.segments import large_enough


def horizontal_stacks(occupied: DataFrame, least: int) -> DataFrame:
    """Cells of vertical stacks of at least `least` cells; the empty cell below a stack counts and is marked too."""
    one_more = occupied.select(*CELL).distinct().union(occupied.select((F.col("i") + 1).alias("i"), *COLUMN)).distinct()
    return in_runs(one_more, F.col("height") >= least)


def vertical_candidates(occupied: DataFrame, least: int) -> DataFrame:
    """Occupied cells outside such stacks and their vertical continuation."""
    return occupied.select(*CELL).distinct().join(grown_vertically(horizontal_stacks(occupied, least), occupied), CELL, "left_anti")


def vertical_segments(cells: DataFrame, occupied: DataFrame, least_area: int) -> DataFrame:
    """Segments (label) of cells whose normal is vertical: 6-connected, those without a surface above among themselves,
    others where the indices of the surfaces above differ by at most one; only of at least `least_area` pixels."""
    above = surface_above(occupied)
    tall = above.select(*COLUMN, "above", F.explode(F.sequence("top", "bottom")).alias("i"))
    at = cells.select(*CELL).join(tall, CELL)
    linked = (F.col("above").isNull() & F.col("n_above").isNull()) | (F.abs(F.col("above") - F.col("n_above")) <= 1)
    return large_enough(label_components(at, 6, F.coalesce(linked, F.lit(False))), least_area).select(*CELL, "label")


def vertical_graph(segments: DataFrame) -> DataFrame:
    """Edges from each segment to the next one above in a column: lower, upper, coverage (columns), distance (mean).

    The outside below and above is -1 and -2; their edges have distance null.
    """
    w = Window.partitionBy(*COLUMN).orderBy("i")
    last = segments.withColumns({"_up": F.lag("label").over(w), "_ui": F.lag("i").over(w), "_dn": F.lead("label").over(w)})
    inner = last.where(F.col("_up").isNotNull() & (F.col("_up") != F.col("label"))).select(F.col("label").alias("lower"), F.col("_up").alias("upper"), (F.col("i") - F.col("_ui")).alias("d"))
    top = last.where(F.col("_up").isNull()).select(F.col("label").alias("lower"), F.lit(-2).cast("long").alias("upper"), F.lit(None).cast("int").alias("d"))
    low = last.where(F.col("_dn").isNull()).select(F.lit(-1).cast("long").alias("lower"), F.col("label").alias("upper"), F.lit(None).cast("int").alias("d"))
    return inner.union(top).union(low).groupBy("lower", "upper").agg(F.count("*").alias("coverage"), F.avg("d").alias("distance"))


def main_above(graph: DataFrame) -> DataFrame:
    """Edges whose lower segment is the one of largest coverage below the upper; ties stay; outside left out."""
    w = Window.partitionBy("upper")
    return graph.where("upper >= 0 AND lower >= 0").withColumn("_m", F.max("coverage").over(w)).where("coverage = _m").drop("_m")


def plane_cells(normals: DataFrame) -> DataFrame:
    """Cells whose four neighbours in the slice all have a normal."""
    at = normals.select(*CELL)
    return neighbour_count(at, at, 4).where("n = 4").select(*CELL)


def without_isolated(normals: DataFrame) -> DataFrame:
    """Cells that face up without a neighbour (N4) that does turn horizontal."""
    up = normals.where("normal = 2").select(*CELL)
    alone = neighbour_count(up, up, 4).where("n = 0").select(*CELL, F.lit(3).alias("_to"))
    return normals.join(alone, CELL, "left").select(*CELL, F.coalesce("_to", "normal").alias("normal"))


def border_fill(segments: DataFrame, normals: DataFrame, offset: int) -> DataFrame:
    """Per segment the share of its border (neighbours N8 outside it) with a cell `offset` below and above."""
    from cellgrove.operators.neighbours import shifted

    at = segments.select(*CELL, "label")
    ring = shifted(at, 8).select(F.col("ni").alias("i"), F.col("nr").alias("r"), F.col("nc").alias("c"), "label").distinct().join(at, [*CELL, "label"], "left_anti")
    full = normals.where("normal <> 0").select(*CELL).distinct()

    def part(step: int, name: str) -> DataFrame:
        there = full.select((F.col("i") - step).alias("i"), *COLUMN).withColumn(name, F.lit(1))
        return there

    both = ring.join(part(offset, "below"), CELL, "left").join(part(-offset, "above"), CELL, "left")
    share = lambda c: F.sum(F.coalesce(c, F.lit(0))) / F.count("*")
    return both.groupBy("label").agg(share("below").alias("below"), share("above").alias("above"))
