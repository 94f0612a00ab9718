"""Vertical scans: windows over the cells of a column (r, c), i growing downward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMN = ["r", "c"]


def down(*keys: str):
    """The window over a column from the top."""
    return Window.partitionBy(*COLUMN, *keys).orderBy("i")


def runs(cells: DataFrame, *keys: str) -> DataFrame:
    """Uninterrupted vertical runs of distinct cells: r, c, keys, top, bottom, height."""
    island = cells.select("i", *COLUMN, *keys).distinct().withColumn("_g", F.col("i") - F.row_number().over(down(*keys)))
    return island.groupBy(*COLUMN, *keys, "_g").agg(F.min("i").alias("top"), F.max("i").alias("bottom"), F.count("*").alias("height")).drop("_g")


def in_runs(cells: DataFrame, condition: Column, *keys: str) -> DataFrame:
    """Cells of the runs for which a condition on top, bottom and height holds."""
    kept = runs(cells, *keys).where(condition)
    return kept.select(*COLUMN, *keys, F.explode(F.sequence("top", "bottom")).alias("i")).select("i", *COLUMN, *keys)


def merged_runs(cells: DataFrame, gap: int, *keys: str) -> DataFrame:
    """Runs of runs: gaps of at most `gap` cells are bridged; `filled` counts the cells without the gaps."""
    w = Window.partitionBy(*COLUMN, *keys).orderBy("top")
    one = runs(cells, *keys).withColumn("_new", (F.col("top") - F.lag("bottom").over(w) > gap + 1).cast("int"))
    one = one.withColumn("_g", F.sum(F.coalesce("_new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return one.groupBy(*COLUMN, *keys, "_g").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.sum("height").alias("filled")).drop("_g")


def grown_vertically(marked: DataFrame, occupied: DataFrame) -> DataFrame:
    """Occupied cells of every vertical run that holds a marked cell."""
    cells = occupied.select("i", *COLUMN).distinct().withColumn("_g", F.col("i") - F.row_number().over(down()))
    at = marked.select("i", *COLUMN).distinct().withColumn("_m", F.lit(1))
    both = cells.join(at, ["i", *COLUMN], "left")
    return both.withColumn("_any", F.max("_m").over(Window.partitionBy(*COLUMN, "_g"))).where("_any = 1").select("i", *COLUMN)


def surface_above(cells: DataFrame) -> DataFrame:
    """Runs with `above`: the lowest cell of the next run above in the column, null without one."""
    return runs(cells).withColumn("above", F.lag("bottom").over(Window.partitionBy(*COLUMN).orderBy("top")))


def next_below(cells: DataFrame, condition: Column, name: str) -> DataFrame:
    """Cells with the i of the next cell below in the column that meets a condition, null without one."""
    below = down().rowsBetween(1, Window.unboundedFollowing)
    return cells.withColumn(name, F.first(F.when(condition, F.col("i")), ignorenulls=True).over(below))


def next_above(cells: DataFrame, condition: Column, name: str) -> DataFrame:
    """Cells with the i of the next cell above that meets a condition."""
    above = down().rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn(name, F.last(F.when(condition, F.col("i")), ignorenulls=True).over(above))


def first_below(starts: DataFrame, targets: DataFrame, name: str = "hit") -> DataFrame:
    """Start cells with the first target cell below them in the column; the start itself doesn't count."""
    found = starts.alias("s").join(targets.select(F.col("i").alias("_t"), *COLUMN), COLUMN).where("_t > i").groupBy("i", *COLUMN).agg(F.min("_t").alias(name))
    return starts.join(found, ["i", *COLUMN], "left")


def pillars(normals: DataFrame) -> DataFrame:
    """Normals after vertical pillars turned horizontal, but for cells of a plane (see plane_cells).

    A pillar is a vertical run of one vertical normal: of two cells or more
    that face up, whose top cell stays, of three or more that face down, or of
    two or more that face both ways. The last face up at the top and down at
    the bottom; the plane cells between that follow each other are halved
    alike, an odd one in the middle stays. What so faces down counts in the
    runs that do.
    """
    from cellgrove.operators.neighbours import CELL
    from cellgrove.operators.normals import plane_cells

    flat = plane_cells(normals).withColumn("flat", F.lit(True))
    at = normals.select(*CELL, "normal").join(flat, CELL, "left").withColumn("flat", F.coalesce("flat", F.lit(False)))

    def in_run(df: DataFrame, normal: str, name: str, *keys: str) -> DataFrame:
        """Places `name`_p from 0 on in runs of equal `normal` (and keys), and their cells `name`_n."""
        g = F.col("i") - F.row_number().over(Window.partitionBy(*COLUMN, normal, *keys).orderBy("i"))
        df = df.withColumn("_g", g)
        w = Window.partitionBy(*COLUMN, normal, *keys, "_g")
        return df.withColumns({f"{name}_p": F.row_number().over(w.orderBy("i")) - 1, f"{name}_n": F.count("*").over(w)}).drop("_g")

    out = in_run(at, "normal", "run")
    out = out.withColumn("flat_in", F.col("flat") & (F.col("run_p") > 0) & (F.col("run_p") < F.col("run_n") - 1))
    out = in_run(out, "normal", "plane", "flat_in")
    half = F.floor(F.col("plane_n") / 2)
    both = (
        F.when(F.col("run_n") < 2, 4).when(F.col("run_p") == 0, 2).when(F.col("run_p") == F.col("run_n") - 1, 1).when(~F.col("flat"), 3)
        .when(F.col("plane_p") < half, 2).when(F.col("plane_p") >= F.col("plane_n") - half, 1).otherwise(4)
    )
    up = F.when((F.col("run_n") > 1) & (F.col("run_p") > 0) & ~F.col("flat"), 3).otherwise(2)
    out = out.select(*CELL, "flat", F.when(F.col("normal") == 4, both).when(F.col("normal") == 2, up).otherwise(F.col("normal")).alias("normal"))
    out = in_run(out, "normal", "run")
    return out.select(*CELL, F.when((F.col("normal") == 1) & (F.col("run_n") > 2) & ~F.col("flat"), 3).otherwise(F.col("normal")).cast("int").alias("normal"))


def majority_per_run(cells: DataFrame, label: str) -> DataFrame:
    """Cells whose runs carry one label each: the most frequent, the least of equals."""
    island = cells.select("i", *COLUMN, label).withColumn("_g", F.col("i") - F.dense_rank().over(Window.partitionBy(*COLUMN).orderBy("i")))
    votes = island.groupBy(*COLUMN, "_g", label).agg(F.count("*").alias("_n"))
    best = votes.groupBy(*COLUMN, "_g").agg(F.min(F.struct(-F.col("_n"), F.col(label).alias("l")))["l"].alias("_best"))
    return island.join(best, [*COLUMN, "_g"]).select("i", *COLUMN, F.col("_best").alias(label))
