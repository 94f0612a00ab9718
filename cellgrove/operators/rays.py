"""Marches along directions until a first hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.operators.neighbours import CELL, offsets
from cellgrove.plans.params import CEILING, EMPTY_INTERIOR, FLOOR, INTERIOR_OBJECT


def marched(cells: DataFrame, directions: list[tuple[int, int, int]], straight: int, diagonal: int | None = None) -> DataFrame:
    """Cells once for each step: di, dr, dc, d and the place (ni, nr, nc) reached after d steps.

    Diagonal directions may be given fewer steps.
    """
    far = lambda x: diagonal if diagonal is not None and abs(x[1]) + abs(x[2]) == 2 else straight
    steps = [F.struct(*[F.lit(v).alias(n) for v, n in zip((*x, far(x)), ("di", "dr", "dc", "most"))]) for x in directions]
    out = cells.withColumn("_o", F.explode(F.array(*steps))).withColumn("d", F.explode(F.expr("sequence(1, greatest(_o.most, 1))"))).where("d <= _o.most")
    out = out.withColumns({"di": F.col("_o.di"), "dr": F.col("_o.dr"), "dc": F.col("_o.dc")}).drop("_o")
    return out.withColumns({"ni": F.expr("i + d * di"), "nr": F.expr("r + d * dr"), "nc": F.expr("c + d * dc")})


def first_hits(cells: DataFrame, targets: DataFrame, directions: list[tuple[int, int, int]], straight: int, diagonal: int | None = None) -> DataFrame:
    """For each cell and direction the nearest target: the cell's columns, di, dr, dc, d and the target's columns with n_."""
    at = targets.select(*[F.col(x).alias({"i": "ni", "r": "nr", "c": "nc"}.get(x, f"n_{x}")) for x in targets.columns])
    hits = marched(cells, directions, straight, diagonal).join(at.hint("merge"), ["ni", "nr", "nc"])
    carried = [x for x in at.columns if x not in ("ni", "nr", "nc")]
    best = F.min(F.struct("d", "ni", "nr", "nc", *carried)).alias("_b")
    return hits.groupBy(*cells.columns, "di", "dr", "dc").agg(best).select(*cells.columns, "di", "dr", "dc", "_b.*")


def gaps(grid: DataFrame, normals: DataFrame, straight: int, diagonal: int) -> DataFrame:
    """Cells (i, r, c, cls) that close gaps of a merged grid (i, r, c, cls) within its slices.

    From interior, empty or object, a march in 8 directions over empty cells
    ends at the first cell that isn't. If that is interior, floor or ceiling
    and not the next one, the cells between are empty interior, or an object
    where they have a normal. All marches see the grid as it is given.
    """
    states = grid.groupBy(*CELL).agg(F.max(F.col("cls").isin(EMPTY_INTERIOR, INTERIOR_OBJECT)).alias("inside"), F.max(F.col("cls").isin(EMPTY_INTERIOR, INTERIOR_OBJECT, FLOOR, CEILING)).alias("open"))
    hit = first_hits(states.where("inside").select(*CELL), states.select(*CELL, "open"), offsets(8), straight, diagonal).where("n_open AND d > 1")
    between = hit.withColumn("s", F.explode(F.expr("sequence(1, d - 1)")))
    between = between.select(F.expr("i + s * di").alias("i"), F.expr("r + s * dr").alias("r"), F.expr("c + s * dc").alias("c")).distinct()
    full = normals.where("normal <> 0").select(*CELL).distinct().withColumn("_full", F.lit(True))
    return between.join(full, CELL, "left").select(*CELL, F.when(F.col("_full"), INTERIOR_OBJECT).otherwise(EMPTY_INTERIOR).alias("cls"))


def slope(floors: DataFrame, radius: int, radius_diagonal: int, most: int, walls: DataFrame | None = None) -> DataFrame:
    """Floor cells with the largest height offset to a floor at the radius, over 8 directions; -1 without one.

    The nearest floor in the column there counts, if at most `most` cells off.
    Directions with a wall among the cells of the slice up to the radius don't.
    """
    ends = [(0, a * (radius_diagonal if a and b else radius), b * (radius_diagonal if a and b else radius)) for _, a, b in offsets(8)]
    steps = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for _, a, b in ends])
    at = floors.select(*CELL).distinct()
    moved = at.withColumn("_o", F.explode(steps)).withColumns({"nr": F.col("r") + F.col("_o.dr"), "nc": F.col("c") + F.col("_o.dc")})
    if walls is not None:
        wall = walls.select(F.col("i").alias("ni"), F.col("r").alias("nr"), F.col("c").alias("nc")).distinct()
        met = marched(at, offsets(8), radius, radius_diagonal).join(wall.hint("merge"), ["ni", "nr", "nc"], "left_semi")
        met = met.select(*CELL, F.signum("dr").cast("int").alias("sr"), F.signum("dc").cast("int").alias("sc")).distinct()
        moved = moved.withColumns({"sr": F.signum("_o.dr").cast("int"), "sc": F.signum("_o.dc").cast("int")}).join(met, [*CELL, "sr", "sc"], "left_anti")
    other = at.select(F.col("i").alias("ni"), F.col("r").alias("nr"), F.col("c").alias("nc"))
    off = moved.join(other, ["nr", "nc"]).withColumn("off", F.abs(F.col("ni") - F.col("i"))).where(F.col("off") <= most)
    near = off.groupBy(*CELL, "nr", "nc").agg(F.min("off").alias("off")).groupBy(*CELL).agg(F.max("off").alias("slope"))
    return at.join(near, CELL, "left").withColumn("slope", F.coalesce("slope", F.lit(-1)))


def hit_in_all(cells: DataFrame, targets: DataFrame, straight: int, diagonal: int, condition: Column) -> DataFrame:
    """Cells whose first hit in each of 8 directions meets a condition."""
    hits = first_hits(cells, targets, offsets(8), straight, diagonal).where(condition)
    return hits.groupBy(*cells.columns).agg(F.count("*").alias("_n")).where("_n = 8").drop("_n")
