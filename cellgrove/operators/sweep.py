"""The vertical sweep: classes of a room's cells from its ceiling down to its floor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.operators.columns import COLUMN
from cellgrove.operators.neighbours import CELL
from cellgrove.plans.params import CEILING, EMPTY_INTERIOR, FLOOR, INTERIOR_OBJECT, WALL, WALL_OPENING

C, EI, IO, FL, W, WO = (1 << k for k in (CEILING, EMPTY_INTERIOR, INTERIOR_OBJECT, FLOOR, WALL, WALL_OPENING))


def class_masks(grid: DataFrame) -> DataFrame:
    """The classes of each (cell, room) as bits."""
    return grid.groupBy(*CELL, "room_id").agg(F.bit_or(F.expr("shiftleft(1, cls)")).alias("mask"))


def _has(mask: Column, bits: int) -> Column:
    return mask.bitwiseAND(bits) != 0


def next_mask(above: Column, own: Column, open_other: Column, occupied: Column) -> Column:
    """The classes of a cell from those of the cell above, its own, what other rooms hold there and whether it is occupied.

    A floor ends the room. Below ceilings and interior a cell is interior, an
    object where it is occupied, or a floor where another room begins; below
    walls it is wall, an opening where it is empty. A floor of its own stays,
    with a wall added below a wall or an opening.
    open_other: 2 if another room holds C, EI, IO or a floor without wall, 1 for
    a floor with wall, else 0.
    """
    filled = lambda a, b: F.when(occupied, F.lit(a)).otherwise(F.lit(b))
    keep_ceiling, over_ceiling = F.when(_has(own, C), own), F.when(_has(own, C), F.lit(EI))
    interior = F.when(_has(own, FL), own).when(open_other > 0, F.lit(FL))
    walled = F.when(_has(own, FL), own.bitwiseOR(W))
    return (
        F.when(_has(above, FL), own)
        .when(_has(above, C) & ~_has(above, W), F.coalesce(interior, keep_ceiling, filled(IO, EI)))
        .when(_has(above, EI), F.coalesce(interior, over_ceiling, filled(IO, EI)))
        .when(_has(above, IO), F.coalesce(interior, filled(IO, EI)))
        .when(_has(above, W), F.coalesce(walled, F.when(_has(own, C), F.lit(W)), filled(W, WO)))
        .when(_has(above, WO), F.coalesce(walled, F.when(open_other == 2, F.lit(FL | W)), filled(W, WO)))
        .otherwise(own)
    )


def swept(spans: DataFrame, grid: DataFrame, normals: DataFrame) -> DataFrame:
    """Classes (i, r, c, room_id, mask) of the cells of columns (room_id, r, c, top, bottom) after one sweep.

    Rooms see the grid as it is given, not each other's results; columns that
    other rooms overlap are to be trimmed before. A column is one fold over its
    sorted cells.
    """
    masks = class_masks(grid)
    cells = spans.select("room_id", *COLUMN, "top", F.explode(F.sequence(F.greatest(F.col("top"), F.lit(1)) - 1, F.col("bottom"))).alias("i"))
    own = cells.join(masks, [*CELL, "room_id"], "left")
    kind = F.when(_has(F.col("mask"), C | EI | IO) | (_has(F.col("mask"), FL) & ~_has(F.col("mask"), W)), 2).when(_has(F.col("mask"), FL), 1).otherwise(0)
    other = masks.select(*CELL, F.col("room_id").alias("_o"), kind.alias("_k"))
    seen = cells.join(other, CELL).where("_o <> room_id").groupBy(*CELL, "room_id").agg(F.max("_k").alias("open"))
    full = own.join(seen, [*CELL, "room_id"], "left").join(normals.where("normal <> 0").select(*CELL, F.lit(True).alias("occ")), CELL, "left")
    one = F.struct("i", F.coalesce("mask", F.lit(0)).alias("own"), F.coalesce("open", F.lit(0)).alias("open"), F.coalesce("occ", F.lit(False)).alias("occ"))
    column = full.groupBy("room_id", *COLUMN).agg(F.array_sort(F.collect_list(one)).alias("cells"))
    start = F.struct(F.get("cells", F.lit(0))["own"].alias("above"), F.array().cast("array<struct<i:int,mask:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        mask = next_mask(a["above"], x["own"], x["open"], x["occ"])
        return F.struct(mask.alias("above"), F.concat(a["out"], F.array(F.struct(x["i"].alias("i"), mask.alias("mask")))).alias("out"))

    fold = F.aggregate(F.slice("cells", 2, F.size("cells")), start, step, lambda a: a["out"])
    return column.select("room_id", *COLUMN, F.explode(fold).alias("x")).select("x.i", *COLUMN, "room_id", "x.mask").where("mask <> 0")
