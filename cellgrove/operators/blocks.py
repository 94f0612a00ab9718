"""Neighbourhoods within blocks of cells that carry a margin: a cell travels once or a few times instead of once for each neighbour."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.operators.neighbours import CELL

#: Cells of a block along i, r and c; what a task holds of a block is bounded by their product.
SIDES = (32, 128, 128)


class Block:
    """A block's cells as flat positions in its box, the block with `margin` cells around it."""

    def __init__(self, corner: tuple[int, ...], margin: int):
        self.low = [k * s - margin for k, s in zip(corner, SIDES)]
        self.margin, self.shape = margin, tuple(s + 2 * margin for s in SIDES)

    def grid(self, at: np.ndarray) -> np.ndarray:
        """Which positions of the box are among `at`."""
        out = np.zeros(np.prod(self.shape), dtype=bool)
        out[at] = True
        return out

    def inner(self, grid: np.ndarray, reach: int = 0) -> np.ndarray:
        """Positions that hold in the block and `reach` cells around it."""
        inside = np.zeros(self.shape, dtype=bool)
        part = tuple(slice(self.margin - reach, self.margin + s + reach) for s in SIDES)
        inside[part] = grid.reshape(self.shape)[part]
        return np.flatnonzero(inside)

    def step(self, offset: tuple[int, int, int]) -> int:
        """What an offset adds to a position."""
        i, r, c = offset
        return (i * self.shape[1] + r) * self.shape[2] + c

    def cells(self, at: np.ndarray) -> list[pa.Array]:
        """i, r and c of positions."""
        return [pa.array((x + a).astype(np.int32)) for x, a in zip(np.unravel_index(at, self.shape), self.low)]


def in_blocks(marked: DataFrame, margin: int, f: Callable[[Block, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """f(block, positions, marks) for every block, over the rows (i, r, c, mark) of the block and its margin; repeated rows stay."""
    out = marked
    for x, s in zip(CELL, SIDES):
        at = lambda d: F.floor((F.col(x) + d) / s).cast("int")
        out = out.withColumn(f"b{x}", F.explode(F.sequence(at(-margin), at(margin))))
    place = F.lit(0)
    for x, s in zip(CELL, SIDES):
        place = place * (s + 2 * margin) + F.col(x) - F.col(f"b{x}") * s + margin
    out = out.select(*[f"b{x}" for x in CELL], place.cast("int").alias("at"), F.col("mark").cast("byte").alias("mark"))

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return f(Block(tuple(k.as_py() for k in key), margin), rows.column("at").to_numpy(), rows.column("mark").to_numpy())

    return out.groupBy(*[f"b{x}" for x in CELL]).applyInArrow(run, schema)


def union_marked(*grids: DataFrame) -> DataFrame:
    """Cells of several grids as i, r, c and mark: the grid's number from 0."""
    first, *rest = [g.select(*CELL, F.lit(k).alias("mark")) for k, g in enumerate(grids)]
    for g in rest:
        first = first.union(g)
    return first
