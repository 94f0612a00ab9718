"""Comparison of two grids. Grids are long tables (i, r, c, room_id, cls): a row for each class of each room of a cell."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrove.operators.blocks import Block, in_blocks, union_marked
from cellgrove.operators.neighbours import CELL, with_neighbours


def weighted_mapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many cells each pair of rooms of two grids shares: from_id, to_id, weight."""
    rooms = lambda g, n: g.select(*CELL, F.col("room_id").alias(n)).distinct()
    return rooms(a, "from_id").join(rooms(b, "to_id"), CELL).groupBy("from_id", "to_id").agg(F.count("*").alias("weight"))


def unique_best(mapping: DataFrame, key: str, other: str) -> DataFrame:
    """The partner of the largest weight of the same sign; none where several are equal."""
    w = Window.partitionBy(key)
    same = mapping.where(F.signum(key) == F.signum(other))
    top = same.withColumn("_top", F.max("weight").over(w)).where("weight = _top").withColumn("_n", F.count("*").over(w))
    return top.where("_n = 1").select(key, other, "weight")


def mutual_mapping(mapping: DataFrame) -> DataFrame:
    """Rooms that choose each other."""
    there, back = unique_best(mapping, "from_id", "to_id"), unique_best(mapping, "to_id", "from_id")
    return there.join(back.select("from_id", "to_id"), ["from_id", "to_id"])


def mapping_error(test: DataFrame, truth: DataFrame, mutual: DataFrame) -> DataFrame:
    """One row: cells of both grids, cells in rooms without a mutual partner (once for each such room), and the larger share in percent."""

    def side(grid: DataFrame, key: str, name: str) -> DataFrame:
        rooms = grid.select(*CELL, "room_id").distinct()
        lone = rooms.join(mutual.select(F.col(key).alias("room_id")).distinct(), "room_id", "left_anti")
        return rooms.select(*CELL).distinct().agg(F.count("*").alias(f"{name}_cells")).crossJoin(lone.agg(F.count("*").alias(f"{name}_errors")))

    both = side(test, "from_id", "test").crossJoin(side(truth, "to_id", "truth"))
    return both.withColumn("error", F.greatest(*[F.try_divide(F.col(f"{n}_errors") * 100.0, F.col(f"{n}_cells")) for n in ("test", "truth")]))


def room_scores(test: DataFrame, truth: DataFrame, mutual: DataFrame) -> DataFrame:
    """One row: precision and recall in percent over mapped rooms, and F1."""
    a = test.select(*CELL, F.col("room_id").alias("from_id")).distinct().join(mutual.select("from_id", "to_id"), "from_id")
    b = truth.select(*CELL, F.col("room_id").alias("to_id")).distinct().join(mutual.select("from_id", "to_id"), "to_id")
    hits = a.join(b.select(*CELL, "to_id"), [*CELL, "to_id"], "left_semi").agg(F.count("*").alias("hits"))
    both = a.agg(F.count("*").alias("tested")).crossJoin(b.agg(F.count("*").alias("true"))).crossJoin(hits)
    p, r = F.col("hits") * 100.0 / F.col("tested"), F.col("hits") * 100.0 / F.col("true")
    return both.withColumns({"precision": p, "recall": r}).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def f1(precision: Column, recall: Column) -> Column:
    """Harmonic mean, 0 where it is undefined."""
    return F.coalesce(F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)), F.lit(0.0))


def class_scores(test: DataFrame, truth: DataFrame) -> DataFrame:
    """Per class of the test grid: precision and recall in percent, in the same cell and within the six neighbours, and F1."""
    a, b = test.select(*CELL, "cls").distinct(), truth.select(*CELL, "cls").distinct()

    def found(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
        here = x.join(y, [*CELL, "cls"], "left_semi")
        near = with_neighbours(x, y, 6).where("cls = n_cls").select(*CELL, "cls").union(here).distinct()
        n = lambda d, c: d.groupBy("cls").agg(F.count("*").alias(c))
        return n(x, f"{name}_n").join(n(here, f"{name}_hits"), "cls", "left").join(n(near, f"{name}_near"), "cls", "left")

    out = found(a, b, "test").join(found(b, a, "true"), "cls", "left")
    share = lambda x, n: F.coalesce(F.coalesce(x, F.lit(0)) * 100.0 / F.col(n), F.lit(0.0))
    p, r = share(F.col("test_hits"), "test_n"), share(F.col("true_hits"), "true_n")
    np, nr = share(F.col("test_near"), "test_n"), share(F.col("true_near"), "true_n")
    return out.select("cls", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), np.alias("near_precision"), nr.alias("near_recall"), f1(np, nr).alias("near_f1"))


def normal_scores(test: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: cells with a normal in both grids that agree, and precision and recall in percent."""
    both = test.select(*CELL, F.col("normal").alias("a")).join(truth.select(*CELL, F.col("normal").alias("b")), CELL, "full")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = both.agg(n(F.col("a") == F.col("b")).alias("hits"), n(F.col("a").isNotNull()).alias("tested"), n(F.col("b").isNotNull()).alias("true"))
    return out.withColumns({"precision": F.col("hits") * 100.0 / F.col("tested"), "recall": F.col("hits") * 100.0 / F.col("true")})


def buffer_scores(test: DataFrame, truth: DataFrame, steps: int, resolution: float) -> DataFrame:
    """Per buffer step 0 .. steps: completeness, correctness and mean distance of test cells to the nearest truth cell.

    The nearest is sought in growing cubes; its distance is Euclidean. A test
    cell is a hit of a step if its cube is not larger. Completeness divides the
    same hits by the truth, so it can exceed 1. Cells meet in blocks, not once
    for each cell of the cube.
    """
    found = in_blocks(union_marked(test, truth), steps, _nearest(steps), "ring int, square int, n long").groupBy("ring", "square").agg(F.sum("n").alias("n"))
    best = found.where("ring >= 0 AND n > 0").select("ring", "n", (F.sqrt("square") * resolution * F.col("n")).alias("s"))
    at = found.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("step"))
    per = at.join(F.broadcast(best.groupBy("ring").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))), F.col("ring") <= F.col("step"), "left").groupBy("step").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hits"), F.sum("s").alias("s"))
    n = lambda k: F.sum(F.when((F.col("ring") == -1) & (F.col("square") == k), F.col("n")))
    all_ = per.crossJoin(F.broadcast(found.agg(n(0).alias("tested"), n(1).alias("true"))))
    return all_.select("step", F.try_divide("hits", "true").alias("completeness"), F.try_divide("hits", "tested").alias("correctness"), F.try_divide("s", "hits").alias("accuracy"))


def _nearest(steps: int):
    """Test cells of a block by ring and square of their nearest truth cell; ring -1: all cells of test (0) and truth (1)."""
    span = range(-steps, steps + 1)
    rings: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for o in product(span, repeat=3):
        rings.setdefault((max(map(abs, o)), sum(x * x for x in o)), []).append(o)

    def f(block: Block, at: np.ndarray, marks: np.ndarray) -> pa.Table:
        truth = block.grid(at[marks == 1])
        left = block.inner(block.grid(at[marks == 0]))
        out = [(-1, 0, len(left)), (-1, 1, len(block.inner(truth)))]
        for (ring, square), offsets in sorted(rings.items()):
            near = np.zeros(len(left), dtype=bool)
            for o in offsets:
                near |= truth[left + block.step(o)]
            out.append((ring, square, int(near.sum())))
            left = left[~near]
        ring, square, n = zip(*out)
        return pa.table([pa.array(ring, pa.int32()), pa.array(square, pa.int32()), pa.array(n, pa.int64())], names=["ring", "square", "n"])

    return f


def class_distribution(grid: DataFrame) -> DataFrame:
    """Cells of each class and their share in percent."""
    n = grid.select(*CELL, "cls").distinct().groupBy("cls").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("_all")))).select("cls", "n", (F.col("n") * 100.0 / F.col("_all")).alias("percent"))


def room_label(room: Column, is_ramp: Column) -> Column:
    """R5 for room 5, T3 for transition space -3, with R behind for ramp spaces."""
    return F.concat(F.when(room < 0, "T").otherwise("R"), F.abs(room).cast("string"), F.when(is_ramp, "R").otherwise(""))
