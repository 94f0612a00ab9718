"""Connected components of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.operators.neighbours import CELL, offsets, with_neighbours
from cellgrove.plans.store import stored

_BITS = 21


def cell_id() -> Column:
    """Cells in raster order i, r, c as numbers; coordinates from 0 to 2**21 - 1."""
    return F.shiftleft(F.col("i").cast("long"), 2 * _BITS) + F.shiftleft(F.col("r").cast("long"), _BITS) + F.col("c").cast("long")


def merge_ids(edges: DataFrame) -> DataFrame:
    """Rows (v, label) of the ends of the edges (a, b): label is the least id that links reach.

    Vertices point to their least neighbour and follow the pointers to their
    roots; edges between roots make the next round. Only minima and joins with
    one row for a key are used, so an id with very many edges stays spread.
    """
    ends = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
    left = stored(ends.where("v <> w").distinct(), "cc")
    labels = None
    while not left.isEmpty():
        parent = _roots(stored(left.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("label")), "cc"))
        if labels is None:
            labels = parent
        else:
            to = parent.select(F.col("v").alias("label"), F.col("label").alias("root"))
            labels = stored(labels.join(to, "label", "left").select("v", F.coalesce("root", "label").alias("label")), "cc")
        a = left.join(parent.withColumnRenamed("label", "rv"), "v").select("rv", "w")
        b = a.join(parent.select(F.col("v").alias("w"), F.col("label").alias("rw")), "w").where("rv <> rw")
        left = stored(b.select(F.col("rv").alias("v"), F.col("rw").alias("w")).distinct(), "cc")
    return left.select("v", F.col("w").alias("label")) if labels is None else labels


def _roots(parent: DataFrame) -> DataFrame:
    while True:
        up = parent.select(F.col("v").alias("label"), F.col("label").alias("root"))
        step = stored(parent.join(up, "label").select("v", F.col("root").alias("label"), (F.col("root") != F.col("label")).alias("moved")), "cc")
        parent = step.select("v", "label")
        if step.where("moved").isEmpty():
            return parent


def label_components(cells: DataFrame, k: int, linked: Column | None = None, same: list[str] | None = None, name: str = "label") -> DataFrame:
    """Cells with the raster number of the first cell of their component.

    Cells are linked when they are neighbours (k: 4 or 8 in a slice, 6, 10, 18
    or 26 in the grid) and, if given, `linked` holds: a condition on the columns
    of the cell and, with the prefix n_, of its neighbour. Cells that differ in
    a column of `same` are never linked, and labels are then per its values.
    """
    keys = same or []
    carried = [x for x in cells.columns if x not in CELL]
    at = stored(cells.withColumn("_id", F.xxhash64(*keys, cell_id()) if keys else cell_id()), "cells") if keys else cells.withColumn("_id", cell_id())
    half = [d for d in offsets(k) if d > (0, 0, 0)]
    both = with_neighbours(at.select(*CELL, *carried, "_id"), at.select(*CELL, *carried, "_id"), half)
    for x in keys:
        both = both.where(F.col(x) == F.col(f"n_{x}"))
    if linked is not None:
        both = both.where(linked)
    found = merge_ids(both.select(F.col("_id").alias("a"), F.col("n__id").alias("b")))
    out = at.join(found.withColumnRenamed("v", "_id"), "_id", "left").withColumn("_label", F.coalesce("label", "_id")).drop("label")
    if keys:
        first = out.withColumn("_cell", cell_id()).groupBy("_label").agg(F.min("_cell").alias("_first"))
        return out.join(first, "_label").withColumnRenamed("_first", name).drop("_label", "_id")
    return out.withColumnRenamed("_label", name).drop("_id")


def numbered(labelled: DataFrame, label: str = "label", name: str = "segment") -> DataFrame:
    """Labels as running numbers from 1 in the order of their first cells."""
    from pyspark.sql import Window

    ids = labelled.select(label).distinct().withColumn(name, F.row_number().over(Window.orderBy(label)))
    return labelled.join(ids, label)
