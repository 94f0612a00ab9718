"""Neighbourhoods of cells as joins with a list of offsets."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["i", "r", "c"]


def offsets(k: int) -> list[tuple[int, int, int]]:
    """Offsets (di, dr, dc) of the 4 or 8 cells of a slice around one, or the 6, 10, 18 or 26 of the grid."""
    every = [d for d in product((-1, 0, 1), repeat=3) if any(d)]
    far = lambda d: sum(map(abs, d))
    return {
        4: [d for d in every if d[0] == 0 and far(d) == 1],
        8: [d for d in every if d[0] == 0],
        6: [d for d in every if far(d) == 1],
        10: [d for d in every if d[0] == 0 or far(d) == 1],
        18: [d for d in every if far(d) < 3],
        26: every,
    }[k]


def shifted(cells: DataFrame, k: int | list[tuple[int, int, int]], keep: bool = True) -> DataFrame:
    """Every cell once for each neighbour, as (ni, nr, nc)."""
    at = offsets(k) if isinstance(k, int) else k
    steps = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dr"), F.lit(c).alias("dc")) for a, b, c in at])
    out = cells.withColumn("_o", F.explode(steps))
    out = out.withColumns({"ni": F.col("i") + F.col("_o.di"), "nr": F.col("r") + F.col("_o.dr"), "nc": F.col("c") + F.col("_o.dc")})
    return out.drop("_o")


def with_neighbours(cells: DataFrame, others: DataFrame, k: int | list, how: str = "inner", prefix: str = "n_") -> DataFrame:
    """Cells joined with the rows of `others` at each neighbour; their columns get a prefix.

    Spark counts a cell once, not once for each neighbour, when it estimates
    what it may broadcast; so the join is always a sorted one.
    """
    renamed = others.select(*[F.col(x).alias({"i": "ni", "r": "nr", "c": "nc"}.get(x, prefix + x)) for x in others.columns])
    return shifted(cells, k).join(renamed.hint("merge"), ["ni", "nr", "nc"], how)


def neighbour_count(cells: DataFrame, others: DataFrame, k: int | list, name: str = "n") -> DataFrame:
    """Cells with the number of neighbours that are in `others`."""
    near = with_neighbours(cells.select(*CELL), others.select(*CELL), k).groupBy(*CELL).agg(F.count("*").alias(name))
    return cells.join(near, CELL, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def touching_pairs(cells: DataFrame, label: str, k: int) -> DataFrame:
    """Pairs a < b of labels of neighbouring cells, with the number of contacts."""
    at = cells.select(*CELL, F.col(label).alias("l"))
    both = with_neighbours(at, at, k).where(F.col("l") < F.col("n_l"))
    return both.groupBy(F.col("l").alias("a"), F.col("n_l").alias("b")).agg(F.count("*").alias("contacts"))


def surface(cells: DataFrame, room: str = "room_id") -> DataFrame:
    """Cells that are seen: some neighbour (6) that lies in the grid's bounds hasn't the same room."""
    bounds = cells.agg(*[f(x).alias(f"{n}{x}") for x in CELL for f, n in ((F.min, "lo_"), (F.max, "hi_"))])
    at = cells.select(*CELL, F.col(room).alias("room")).distinct()
    same = with_neighbours(at, at, 6).where("room = n_room").groupBy(*CELL, "room").agg(F.count("*").alias("same"))
    inside = F.lit(0)
    for x in CELL:
        inside = inside + (F.col(x) > F.col(f"lo_{x}")).cast("int") + (F.col(x) < F.col(f"hi_{x}")).cast("int")
    full = at.join(same, [*CELL, "room"], "left").crossJoin(F.broadcast(bounds))
    return full.where(F.coalesce("same", F.lit(0)) < inside).select(*CELL, F.col("room").alias(room))


def filled(column: Column, value) -> Column:
    return F.coalesce(column, F.lit(value))
