"""Ids and labels of walls and ceilings after rooms are partitioned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellgrove.operators.columns import COLUMN
from cellgrove.operators.neighbours import CELL, with_neighbours
from cellgrove.plans.params import CEILING, EMPTY_INTERIOR, FLOOR, INTERIOR_OBJECT, WALL, WALL_OPENING
from cellgrove.plans.store import stored


def inherited_ids(grid: DataFrame, rounds: int | None = None) -> DataFrame:
    """The grid after cells of room 0 took the ids of their neighbours, layer by layer within slices (N4).

    Pure floors and ceilings don't take part. A cell takes every id of
    neighbours that have exactly one; cells of this layer don't count yet.
    Empty interior becomes wall opening, objects become wall.
    """
    ids = grid.groupBy(*CELL).agg(F.array_sort(F.collect_set("room_id")).alias("ids"), F.array_sort(F.collect_set("cls")).alias("classes"))
    has = lambda k: F.array_contains("classes", k)
    at = stored(ids, "ids")
    fixed = F.array(F.lit(0))
    can = (F.col("ids") == fixed) & (has(WALL) | ~(has(FLOOR) | has(CEILING)))
    left, new = stored(at.where(can), "left"), at.where((F.size("ids") == 1) & (F.get("ids", F.lit(0)) != 0)).select(*CELL, F.get("ids", F.lit(0)).alias("id"))
    sources, taken, n = stored(new, "ids"), None, 0
    while rounds is None or n < rounds:
        layer = stored(with_neighbours(left.select(*CELL), sources, 4).groupBy(*CELL).agg(F.array_sort(F.collect_set("n_id")).alias("ids")), "layer")
        if layer.isEmpty():
            break
        taken = layer if taken is None else stored(taken.union(layer), "taken")
        left = stored(left.join(layer.select(*CELL), CELL, "left_anti"), "left")
        sources = stored(sources.union(layer.where(F.size("ids") == 1).select(*CELL, F.get("ids", F.lit(0)).alias("id"))), "ids")
        n += 1
    if taken is None:
        return grid
    cls = F.when(F.col("cls") == EMPTY_INTERIOR, WALL_OPENING).when(F.col("cls") == INTERIOR_OBJECT, WALL).otherwise(F.col("cls"))
    moved = grid.join(taken, CELL).select(*CELL, F.explode("ids").alias("room_id"), cls.alias("cls")).distinct()
    return grid.join(taken.select(*CELL), CELL, "left_anti").select(*CELL, "room_id", "cls").union(moved)


def ceilings_of_stack(grid: DataFrame) -> DataFrame:
    """The grid (i, r, c, room_id, cls) after room 0 went, column by column from below.

    A cell of room 0 right above a cell that stays becomes ceiling of that
    cell's first room, and nothing else; so do those of room 0 above it. Other
    cells only lose room 0, and stay if they hold another room.
    """
    cells = grid.groupBy(*CELL).agg(F.max(F.col("room_id") == 0).alias("zero"), F.min(F.when(F.col("room_id") != 0, F.col("room_id"))).alias("first"))
    cells = cells.withColumn("_g", F.col("i") - F.row_number().over(Window.partitionBy(*COLUMN).orderBy("i")))
    below = Window.partitionBy(*COLUMN, "_g").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    stays = cells.withColumn("_start", F.max(F.col("first").isNotNull()).over(below))
    # rooms are handed up by cells without room 0, and by the lowest that stays
    stays = stays.withColumn("_own", F.when(~F.col("zero") | ~F.coalesce("_start", F.lit(False)), F.col("first")))
    stays = stays.withColumn("_from", F.when(F.col("zero"), F.last("_own", ignorenulls=True).over(below)))
    marked = stays.select(*CELL, "_from")
    new = marked.where("_from IS NOT NULL").select(*CELL, F.col("_from").alias("room_id"), F.lit(CEILING).alias("cls"))
    old = grid.where("room_id <> 0").join(marked.where("_from IS NULL").select(*CELL), CELL).select(*CELL, "room_id", "cls")
    return old.union(new)


def false_walls(grid: DataFrame) -> DataFrame:
    """(cell, room) of ceilings and floors whose wall label goes: interior of the room follows, below a ceiling or above a floor."""
    room = grid.groupBy(*CELL, "room_id").agg(F.collect_set("cls").alias("k"))
    inside = room.where(F.arrays_overlap("k", F.array(F.lit(EMPTY_INTERIOR), F.lit(INTERIOR_OBJECT)))).select(*CELL, "room_id")
    wall = room.where(F.array_contains("k", WALL))

    def side(cls: int, step: int) -> DataFrame:
        there = inside.select((F.col("i") - step).alias("i"), *COLUMN, "room_id")
        return wall.where(F.array_contains("k", cls)).join(there, [*CELL, "room_id"], "left_semi").select(*CELL, "room_id")

    return side(CEILING, 1).union(side(FLOOR, -1)).distinct()
