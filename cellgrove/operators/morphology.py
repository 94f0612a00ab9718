"""Erosion, dilation and growth of cell sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.operators.blocks import Block, in_blocks, union_marked
from cellgrove.operators.neighbours import CELL, neighbour_count, shifted, with_neighbours
from cellgrove.plans.store import stored


def disc(radius: int) -> list[tuple[int, int, int]]:
    """Offsets of a disc of the window of 2 * radius - 1 cells."""
    span = range(1 - radius, radius)
    return [(0, a, b) for a in span for b in span if a * a + b * b <= radius * radius]


def ball(radius: int) -> list[tuple[int, int, int]]:
    """Offsets of a ball of that window."""
    span = range(1 - radius, radius)
    return [(a, b, c) for a in span for b in span for c in span if a * a + b * b + c * c <= radius * radius]


def eroded(cells: DataFrame, kernel: list[tuple[int, int, int]]) -> DataFrame:
    """Cells whose whole kernel is in the set."""
    cells = cells.select(*CELL).distinct()
    return neighbour_count(cells, cells, kernel, "_n").where(F.col("_n") == len(kernel)).select(*CELL)


def dilated(cells: DataFrame, kernel: list[tuple[int, int, int]], within: DataFrame | None = None) -> DataFrame:
    """Cells of the kernels around the set; only those of `within` if given."""
    out = shifted(cells.select(*CELL).distinct(), kernel).select(F.col("ni").alias("i"), F.col("nr").alias("r"), F.col("nc").alias("c")).distinct()
    return out if within is None else out.join(within.select(*CELL).distinct().hint("merge"), CELL, "left_semi")


def opened(cells: DataFrame, kernel: list[tuple[int, int, int]]) -> DataFrame:
    """Erosion, then dilation."""
    return dilated(eroded(cells, kernel), kernel)


def closed_within(cells: DataFrame, kernel: list[tuple[int, int, int]], within: DataFrame) -> DataFrame:
    """Closing that only takes up cells of `within`; cells outside it don't count as missing when it erodes."""
    reach = max([0, *(abs(x) for o in kernel for x in o)])

    def f(block: Block, at: np.ndarray, marks: np.ndarray) -> pa.Table:
        seeds, inside = block.grid(at[marks == 0]), block.grid(at[marks == 1])
        near = block.inner(inside, reach)
        steps = [block.step(o) for o in kernel]
        found = _any(seeds, near, steps)
        lacking = block.grid(near[~found])
        own = block.inner(block.grid(near[found]))
        return pa.table(block.cells(own[~_any(lacking, own, steps)]), names=CELL)

    # what a cell keeps depends on cells within its kernel's reach, and they on seeds within theirs
    out = in_blocks(union_marked(cells, within), 2 * reach, f, "i int, r int, c int")
    return out.select(*[F.col(x).cast(within.schema[x].dataType).alias(x) for x in CELL])


def _any(grid: np.ndarray, at: np.ndarray, steps: list[int]) -> np.ndarray:
    """Which positions lie a step behind one that holds."""
    out = np.zeros(len(at), dtype=bool)
    for s in steps:
        out |= grid[at - s]
    return out


def grown(labelled: DataFrame, free: DataFrame, k: int, label: str = "label", rounds: int | None = None) -> DataFrame:
    """Labels spread over free cells layer by layer; where several meet, the least wins. Ends when no cell is reached."""
    have = stored(labelled.select(*CELL, label), "grown")
    layer, left, n = have, free.select(*CELL).join(have, CELL, "left_anti"), 0
    while rounds is None or n < rounds:
        reach = with_neighbours(left, layer, k, prefix="_").groupBy(*CELL).agg(F.min(f"_{label}").alias(label))
        layer = stored(reach, "grown")
        if layer.isEmpty():
            break
        have = stored(have.union(layer), "grown")
        left, n = stored(left.join(layer, CELL, "left_anti"), "grown"), n + 1
    return have
