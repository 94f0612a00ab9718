"""Ceilings, floors, holes and walls of rooms; transfer of ids over a grid (i, r, c, room_id, cls)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrove.operators.columns import COLUMN, in_runs, next_above, next_below, runs
from cellgrove.operators.components import label_components, numbered
from cellgrove.operators.neighbours import CELL, neighbour_count, with_neighbours
from cellgrove.operators.segments import large_enough
from cellgrove.plans.params import CEILING, EMPTY_INTERIOR, FLOOR, INTERIOR_OBJECT, WALL, WALL_OPENING


def of_class(grid: DataFrame, *classes: int) -> DataFrame:
    """Distinct cells that hold one of the classes."""
    return grid.where(F.col("cls").isin(*classes)).select(*CELL).distinct()


def interior(grid: DataFrame) -> DataFrame:
    """Cells of empty interior or interior objects."""
    return of_class(grid, EMPTY_INTERIOR, INTERIOR_OBJECT)


def floor_incidence(normals: DataFrame) -> DataFrame:
    """For each height the number of cells that face up."""
    return normals.where(F.col("normal").isin(2, 4)).groupBy("i").agg(F.count("*").alias("n"))


def ceilings(normals: DataFrame, least: int) -> DataFrame:
    """Ceiling segments: cells that face down, 6-connected, whose footprint has at least `least` cells; room_id from 1."""
    down = normals.where(F.col("normal").isin(1, 4)).select(*CELL)
    kept = large_enough(label_components(down, 6), least)
    return numbered(kept, "label", "room_id").select(*CELL, "room_id")


def top_ceiling(ceiling: DataFrame) -> DataFrame:
    """The topmost ceiling of every pixel of a room: room_id, r, c, height."""
    return ceiling.groupBy("room_id", *COLUMN).agg(F.min("i").alias("height"))


def first_floor(pixels: DataFrame, normals: DataFrame) -> DataFrame:
    """Pixels (room_id, r, c, height) with the first cell below the ceiling that faces up, null without one."""
    up = normals.where(F.col("normal").isin(2, 4)).select(F.col("i").alias("_f"), *COLUMN)
    hit = pixels.join(up, COLUMN).where("_f > height").groupBy("room_id", *COLUMN).agg(F.min("_f").alias("floor"))
    return pixels.join(hit, ["room_id", *COLUMN], "left")


def hole_pixels(pixels: DataFrame) -> DataFrame:
    """Missing pixels of a room (room_id, r, c) with pixels of it on both sides in the row, column or a diagonal."""
    at = pixels.select("room_id", *COLUMN).distinct()
    box = at.groupBy("room_id").agg(*[f(x).alias(f"{n}_{x}") for x in COLUMN for f, n in ((F.min, "lo"), (F.max, "hi"))])
    every = box.select("room_id", F.explode(F.sequence("lo_r", "hi_r")).alias("r"), "lo_c", "hi_c").select("room_id", "r", F.explode(F.sequence("lo_c", "hi_c")).alias("c"))
    full = every.join(at.withColumn("_in", F.lit(1)), ["room_id", *COLUMN], "left")
    enclosed = F.lit(False)
    for line, along in ((F.col("r"), "c"), (F.col("c"), "r"), (F.col("r") - F.col("c"), "r"), (F.col("r") + F.col("c"), "r")):
        w = Window.partitionBy("room_id", line).orderBy(along)
        enclosed = enclosed | (F.max("_in").over(w.rowsBetween(Window.unboundedPreceding, -1)).isNotNull() & F.max("_in").over(w.rowsBetween(1, Window.unboundedFollowing)).isNotNull())
    return full.withColumn("_hole", enclosed).where("_in IS NULL AND _hole").select("room_id", *COLUMN)


def wall_pixels(pixels: DataFrame) -> DataFrame:
    """Pixels around a room (N8) that it lacks, with the lowest ceiling and the highest floor of its neighbours."""
    from cellgrove.operators.neighbours import offsets

    at = pixels.select("room_id", *COLUMN, "height", "floor")
    steps = F.array(*[F.struct(F.lit(b).alias("dr"), F.lit(c).alias("dc")) for _, b, c in offsets(8)])
    near = at.withColumn("_o", F.explode(steps)).select("room_id", (F.col("r") + F.col("_o.dr")).alias("r"), (F.col("c") + F.col("_o.dc")).alias("c"), "height", "floor")
    out = near.groupBy("room_id", *COLUMN).agg(F.max("height").alias("height"), F.min("floor").alias("floor"))
    return out.join(at.select("room_id", *COLUMN), ["room_id", *COLUMN], "left_anti")


def floor_segments(pixels: DataFrame, step: int, k: int = 8) -> DataFrame:
    """Pixels (room_id, r, c, height) with a label: neighbours whose heights differ by at most `step` are linked."""
    flat = pixels.select(F.lit(0).alias("i"), *COLUMN, "room_id", "height")
    return label_components(flat, k, F.abs(F.col("height") - F.col("n_height")) <= step, same=["room_id"]).drop("i")


def dominant_floors(segments: DataFrame, incidence: DataFrame) -> DataFrame:
    """Segments (room_id, label) of each room with the largest sum of the incidence of their heights; ties stay."""
    score = segments.join(F.broadcast(incidence.select(F.col("i").alias("height"), F.col("n").alias("_n"))), "height", "left").groupBy("room_id", "label").agg(F.sum(F.coalesce("_n", F.lit(0))).alias("score"))
    w = Window.partitionBy("room_id")
    return score.withColumn("_m", F.max("score").over(w)).where("score = _m").drop("_m")


def roomless(normals: DataFrame, grid: DataFrame) -> DataFrame:
    """Cells with a normal that no room holds."""
    return normals.join(grid.select(*CELL).distinct(), CELL, "left_anti")


def roomless_assigned(loose: DataFrame, grid: DataFrame, reach: int) -> DataFrame:
    """Roomless cells with the room and class of the closest ceiling or floor in their column within reach.

    Cells that face down look below, those that face up above, others both
    ways; of equally near ones the one above and the least room count.
    """
    target = grid.where(F.col("cls").isin(CEILING, FLOOR)).select(F.col("i").alias("_i"), *COLUMN, "room_id", "cls").distinct()
    near = loose.join(target, COLUMN).withColumn("d", F.col("_i") - F.col("i")).where((F.abs("d") <= reach) & (F.col("d") != 0))
    near = near.where("(normal = 1 AND d > 0) OR (normal = 2 AND d < 0) OR normal NOT IN (1, 2)")
    best = F.min(F.struct(F.abs("d").alias("a"), "d", "room_id", "cls")).alias("b")
    return near.groupBy(*CELL).agg(best).select(*CELL, "b.room_id", "b.cls")


def merged_rooms(grid: DataFrame) -> DataFrame:
    """All rooms as room 0: surfaces if a cell has any, else object, else empty interior."""
    has = lambda *k: F.max(F.col("cls").isin(*k))
    s = grid.groupBy(*CELL).agg(F.array_sort(F.collect_set(F.when(F.col("cls").isin(CEILING, FLOOR, WALL), F.col("cls")))).alias("s"), has(INTERIOR_OBJECT).alias("o"))
    classes = F.when(F.size("s") > 0, F.col("s")).when(F.col("o"), F.array(F.lit(INTERIOR_OBJECT))).otherwise(F.array(F.lit(EMPTY_INTERIOR)))
    return s.select(*CELL, F.lit(0).alias("room_id"), F.explode(classes).alias("cls"))


def wall_grid(grid: DataFrame, least: int) -> DataFrame:
    """Wall cells of columns with at least `least` wall cells below one that is wall and ceiling."""
    walls = of_class(grid, WALL)
    top = walls.join(of_class(grid, CEILING), CELL, "left_semi").select(F.col("i").alias("_t"), *COLUMN)
    stacked = runs(walls).where(F.col("height") >= least)
    kept = stacked.join(top, COLUMN).where("_t BETWEEN top AND bottom").groupBy(*COLUMN, "bottom").agg(F.min("_t").alias("top"))
    kept = kept.where(F.col("bottom") - F.col("top") + 1 >= least)
    return kept.select(F.explode(F.sequence("top", "bottom")).alias("i"), *COLUMN)


def outside(grid: DataFrame, empty: DataFrame, lo: tuple[int, int], hi: tuple[int, int]) -> DataFrame:
    """Empty cells that are linked to the border of their slice over empty cells (N4)."""
    labelled = label_components(empty.select(*CELL), 4)
    edge = labelled.where((F.col("r") == lo[0]) | (F.col("r") == hi[0]) | (F.col("c") == lo[1]) | (F.col("c") == hi[1])).select("label").distinct()
    return labelled.join(edge, "label", "left_semi").select(*CELL)


def enclosed_filled(grid: DataFrame, empty: DataFrame, lo: tuple[int, int], hi: tuple[int, int]) -> DataFrame:
    """Enclosed empty parts of slices that touch one room only, as empty interior of it: i, r, c, room_id, cls."""
    labelled = label_components(empty.select(*CELL), 4)
    edge = labelled.where((F.col("r") == lo[0]) | (F.col("r") == hi[0]) | (F.col("c") == lo[1]) | (F.col("c") == hi[1])).select("label").distinct()
    inner = labelled.join(edge, "label", "left_anti")
    near = with_neighbours(inner, grid.select(*CELL, "room_id").distinct(), 4).groupBy("label").agg(F.min("n_room_id").alias("lo"), F.max("n_room_id").alias("hi"))
    return inner.join(near.where("lo = hi").select("label", F.col("lo").alias("room_id")), "label").select(*CELL, "room_id", F.lit(EMPTY_INTERIOR).alias("cls"))


def with_empty_interior(grid: DataFrame) -> DataFrame:
    """Cells between a ceiling and the next floor of the same room below it, as empty interior where the room has no class."""
    keyed = grid.where(F.col("cls").isin(CEILING, FLOOR)).select(*CELL, "room_id", "cls").distinct()
    w = Window.partitionBy(*COLUMN, "room_id").orderBy("i").rangeBetween(1, Window.unboundedFollowing)
    to = keyed.withColumn("_f", F.first(F.when(F.col("cls") == FLOOR, F.col("i")), ignorenulls=True).over(w)).where((F.col("cls") == CEILING) & (F.col("_f") > F.col("i") + 1))
    between = to.select(F.explode(F.sequence(F.col("i") + 1, F.col("_f") - 1)).alias("i"), *COLUMN, "room_id").distinct()
    fresh = between.join(grid.select(*CELL, "room_id").distinct(), [*CELL, "room_id"], "left_anti")
    return grid.select(*CELL, "room_id", "cls").union(fresh.withColumn("cls", F.lit(EMPTY_INTERIOR)))


def closed_columns(grid: DataFrame) -> DataFrame:
    """Interior cells at the open ends of their columns get a ceiling above and a floor below: the classes added."""
    inside = grid.where(F.col("cls").isin(EMPTY_INTERIOR, INTERIOR_OBJECT)).select(*CELL, "room_id").distinct()
    held = grid.select(*CELL, "room_id").distinct()

    def end(step: int, cls: int) -> DataFrame:
        there = held.select((F.col("i") - step).alias("i"), *COLUMN, "room_id")
        return inside.join(there, [*CELL, "room_id"], "left_anti").withColumn("cls", F.lit(cls))

    return end(-1, CEILING).union(end(1, FLOOR))


def openings_dropped(grid: DataFrame) -> DataFrame:
    """The grid without wall openings where the room has another class in the cell."""
    n = grid.withColumn("_n", F.count("*").over(Window.partitionBy(*CELL, "room_id")))
    return n.where((F.col("cls") != WALL_OPENING) | (F.col("_n") == 1)).drop("_n")


def beside_outside(grid: DataFrame, outside_cells: DataFrame, diagonal: bool) -> DataFrame:
    """Cells of the grid with an outside cell next to them in the slice."""
    return neighbour_count(grid.select(*CELL).distinct(), outside_cells, 8 if diagonal else 4).where("n > 0").select(*CELL)


def beside_interior(grid: DataFrame) -> DataFrame:
    """(cell, room) with an interior object of the same room next to it in the slice; empty interior doesn't count."""
    inside = grid.where(F.col("cls") == INTERIOR_OBJECT).select(*CELL, "room_id").distinct()
    at = grid.select(*CELL, "room_id").distinct()
    return with_neighbours(at, inside, 4).where("room_id = n_room_id").select(*CELL, "room_id").distinct()


def ids_to_surfaces(spaces: DataFrame, grid: DataFrame) -> DataFrame:
    """Ids of interior cells for the ceilings above and floors below: i, r, c, space_id.

    From an interior cell the id goes up through ceilings and down through
    floors until the first cell that lacks the class.
    """
    out = []
    for cls, up in ((CEILING, True), (FLOOR, False)):
        stack = runs(of_class(grid, cls))
        meet = F.col("i") - 1 == F.col("bottom") if up else F.col("i") + 1 == F.col("top")
        hit = spaces.join(stack, COLUMN).where(meet)
        out.append(hit.select(F.explode(F.sequence("top", "bottom")).alias("i"), *COLUMN, "space_id"))
    return out[0].union(out[1]).distinct()


def walls_lower_than(grid: DataFrame, least: int) -> DataFrame:
    """Wall cells (cell, room) in runs of fewer than `least`."""
    walls = grid.where(F.col("cls") == WALL).select(*CELL, "room_id").distinct()
    return in_runs(walls, F.col("height") < least, "room_id")


def transition_columns(interior_cells: DataFrame, transition: DataFrame, least: int) -> DataFrame:
    """Interior runs of at least `least` cells with as many transition cells, whole; all other transition cells go."""
    both = runs(interior_cells).where(F.col("height") >= least).join(transition.select(F.col("i").alias("_t"), *COLUMN).distinct(), COLUMN)
    n = both.where("_t BETWEEN top AND bottom").groupBy(*COLUMN, "top", "bottom").agg(F.count("*").alias("n"))
    return n.where(F.col("n") >= least).select(F.explode(F.sequence("top", "bottom")).alias("i"), *COLUMN)


def false_fragments(grid: DataFrame, straight: int, diagonal: int) -> DataFrame:
    """Wall cells (cell, room) whose rays in all 8 directions first meet a cell of the same room that isn't wall."""
    from cellgrove.operators.rays import hit_in_all

    walls = grid.where(F.col("cls") == WALL).select(*CELL, "room_id").distinct()
    rest = grid.join(walls, [*CELL, "room_id"], "left_anti").groupBy(*CELL).agg(F.array_sort(F.collect_set("room_id")).alias("rooms"))
    return hit_in_all(walls, rest, straight, diagonal, F.expr("array_contains(n_rooms, room_id)"))


def height_of_ceiling(heights: DataFrame, default: int) -> DataFrame:
    """Per candidate the most frequent height, the least of equals; twice a default where there is none."""
    n = heights.where("height IS NOT NULL").groupBy("candidate", "height").agg(F.count("*").alias("n"))
    best = n.groupBy("candidate").agg(F.min(F.struct(-F.col("n"), "height"))["height"].alias("height"))
    return heights.select("candidate").distinct().join(best, "candidate", "left").withColumn("height", F.coalesce("height", F.lit(2 * default)))


def lookaround(grid: DataFrame, condition: Column) -> DataFrame:
    """Cells with the next cell above and below in the column that meets a condition: above, below."""
    return next_below(next_above(grid, condition, "above"), condition, "below")
