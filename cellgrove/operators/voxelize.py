"""Points, triangles and meshes to grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.plans.params import Params

XYZ = ("x", "y", "z")


def bounds(points: DataFrame) -> DataFrame:
    """One row: least and largest coordinate of each axis and the centroid."""
    out = [f(a).alias(f"{n}{a}") for a in XYZ for f, n in ((F.min, "min_"), (F.max, "max_"), (F.avg, "mean_"))]
    return points.agg(*out)


def grid_of(box: DataFrame, resolution: float) -> DataFrame:
    """Offset and size of the grid of a box (min_x .. max_z) padded by one cell on all sides; i from y, r from x, c from z."""
    size = lambda a: F.ceil((F.col(f"max_{a}") + resolution - (F.col(f"min_{a}") - resolution)) / resolution).cast("int")
    return box.select(*[(F.col(f"min_{a}") - resolution).alias(f"o{a}") for a in XYZ], size("y").alias("ni"), size("x").alias("nr"), size("z").alias("nc"))


def point_cells(points: DataFrame, grid: DataFrame, resolution: float) -> DataFrame:
    """Points with their cell, cut off towards zero."""
    at = points.crossJoin(F.broadcast(grid.select("ox", "oy", "oz")))
    cell = lambda a: ((F.col(a) - F.col(f"o{a}")) / resolution).cast("int")
    return at.withColumns({"i": cell("y"), "r": cell("x"), "c": cell("z")}).drop("ox", "oy", "oz")


def occupied(points: DataFrame, grid: DataFrame, resolution: float) -> DataFrame:
    """Cells that hold a point."""
    return point_cells(points, grid, resolution).select("i", "r", "c").distinct()


def rotated(points: DataFrame, degrees: float, axis: tuple[float, float, float], anchor: DataFrame) -> DataFrame:
    """Points turned around an axis through an anchor (mean_x, mean_y, mean_z)."""
    n = math.sqrt(sum(v * v for v in axis))
    u, v, w = (x / n for x in axis)
    a = math.radians(degrees)
    cos, sin = math.cos(a), math.sin(a)
    k = 1 - cos
    m = [
        [cos + u * u * k, u * v * k - w * sin, u * w * k + v * sin],
        [v * u * k + w * sin, cos + v * v * k, v * w * k - u * sin],
        [w * u * k - v * sin, w * v * k + u * sin, cos + w * w * k],
    ]
    at = points.crossJoin(F.broadcast(anchor.select(*[F.col(f"mean_{x}").alias(f"_a{x}") for x in XYZ])))
    rel = {x: F.col(x) - F.col(f"_a{x}") for x in XYZ}
    new = {x: F.col(f"_a{x}") + sum((F.lit(m[j][i]) * rel[y] for i, y in enumerate(XYZ)), F.lit(0.0)) for j, x in enumerate(XYZ)}
    return at.withColumns(new).drop(*[f"_a{x}" for x in XYZ])


def triangle_axes() -> list[str]:
    """SQL conditions of the separating-axis test of a triangle (p1..p3 relative to the box's centre) and a cube of half edge h.

    The same text serves Spark and other SQL engines: columns x1, y1, z1 .. x3, y3, z3 and h.
    """
    out = [f"least({a}1, {a}2, {a}3) <= h AND greatest({a}1, {a}2, {a}3) >= -h" for a in XYZ]
    edges = [("1", "2"), ("2", "3"), ("3", "1")]
    for p, q in edges:
        e = {a: f"({a}{q} - {a}{p})" for a in XYZ}
        for unit in range(3):
            a, b = XYZ[(unit + 1) % 3], XYZ[(unit + 2) % 3]
            dots = [f"({e[a]} * {b}{v} - {e[b]} * {a}{v})" for v in "123"]
            reach = f"h * (abs({e[a]}) + abs({e[b]}))"
            out.append(f"least({', '.join(dots)}) <= {reach} AND greatest({', '.join(dots)}) >= -({reach})")
    n = normal_sql()
    out.append(f"abs({' + '.join(f'({n[i]}) * {a}1' for i, a in enumerate(XYZ))}) <= h * ({' + '.join(f'abs({x})' for x in n)})")
    return out


def normal_sql() -> list[str]:
    """SQL of the normal of a triangle, by the right-hand rule."""
    d = lambda a, q: f"({a}{q} - {a}1)"
    return [f"{d(a, 2)} * {d(b, 3)} - {d(b, 2)} * {d(a, 3)}" for a, b in (("y", "z"), ("z", "x"), ("x", "y"))]


def triangle_cells(triangles: DataFrame, grid: DataFrame, resolution: float) -> DataFrame:
    """Triangles (x1 .. z3) once for each cell whose cube they meet; cells are centred at offset + index * resolution."""
    at = triangles.crossJoin(F.broadcast(grid.select("ox", "oy", "oz")))
    lo = lambda a: F.floor((F.least(*[F.col(f"{a}{k}") for k in "123"]) - F.col(f"o{a}")) / resolution).cast("int")
    hi = lambda a: F.ceil((F.greatest(*[F.col(f"{a}{k}") for k in "123"]) - F.col(f"o{a}")) / resolution).cast("int")
    for name, a in (("i", "y"), ("r", "x"), ("c", "z")):
        at = at.withColumn(name, F.explode(F.sequence(lo(a), hi(a))))
    for name, a in (("i", "y"), ("r", "x"), ("c", "z")):
        at = at.withColumns({f"_{a}{k}": F.col(f"{a}{k}") - (F.col(f"o{a}") + F.col(name) * resolution) for k in "123"})
    plain = at.withColumnsRenamed({f"{a}{k}": f"_keep_{a}{k}" for a in XYZ for k in "123"}).withColumnsRenamed({f"_{a}{k}": f"{a}{k}" for a in XYZ for k in "123"})
    met = plain.withColumn("h", F.lit(resolution / 2))
    for condition in triangle_axes():
        met = met.where(condition)
    return met.drop("h", "ox", "oy", "oz", *[f"{a}{k}" for a in XYZ for k in "123"]).withColumnsRenamed({f"_keep_{a}{k}": f"{a}{k}" for a in XYZ for k in "123"})


def direction(params: Params = Params()) -> Column:
    """1 down, 2 up, 3 horizontal for a triangle: its normal's angle to (0, -1, 0) or (0, 1, 0) against the thresholds."""
    x, y, z = (F.expr(e) for e in normal_sql())
    length = F.sqrt(x * x + y * y + z * z)
    cos = F.when(length > 0, y / length).otherwise(F.lit(0.0))
    return F.when(-cos > math.cos(math.radians(params.down_angle)), 1).when(cos > math.cos(math.radians(params.up_angle)), 2).otherwise(3)


def normal_class(down: Column, up: Column, horizontal: Column) -> Column:
    """The normal of a cell from counts: horizontal if it is at least both others; both if down and up each have 0.3 of
    all three counts; else the larger of down and up, down if they are equal."""
    least = 0.3 * (down + up + horizontal)
    return F.when((horizontal >= down) & (horizontal >= up), 3).when((down >= least) & (up >= least), 4).when(down >= up, 1).otherwise(2)


def mesh_normals(triangles: DataFrame, grid: DataFrame, resolution: float, params: Params = Params()) -> DataFrame:
    """Normal grid (i, r, c, normal) of a mesh: counts of triangles per direction, folded by partial sums."""
    cells = triangle_cells(triangles, grid, resolution).withColumn("d", direction(params))
    n = lambda k: F.sum((F.col("d") == k).cast("int"))
    counts = cells.groupBy("i", "r", "c").agg(n(1).alias("down"), n(2).alias("up"), n(3).alias("side"))
    return counts.select("i", "r", "c", normal_class(F.col("down"), F.col("up"), F.col("side")).alias("normal"))


def triangles_of(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces (f, v1, v2, v3) of a mesh with the coordinates of their vertices (v, x, y, z)."""
    out = faces
    for k in "123":
        out = out.join(vertices.select(F.col("v").alias(f"v{k}"), *[F.col(a).cast("double").alias(f"{a}{k}") for a in XYZ]), f"v{k}")
    return out


def merged_meshes(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Several meshes (mesh_id) as one: vertex numbers are shifted by the vertices of the meshes before."""
    from pyspark.sql import Window

    sizes = vertices.groupBy("mesh_id").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("mesh_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = F.broadcast(sizes.select("mesh_id", before.alias("s")))
    v = vertices.join(shift, "mesh_id").withColumn("v", F.col("v") + F.col("s")).drop("s", "mesh_id")
    f = faces.join(shift, "mesh_id").withColumns({k: F.col(k) + F.col("s") for k in ("v1", "v2", "v3")}).drop("s", "mesh_id")
    return v, f


def cubes(cells: DataFrame, edge: float = 1.0) -> DataFrame:
    """Corners of the cubes of cells: cell columns, corner 0 to 7 and x, y, z; centred at (r, -i, c) * edge."""
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("corner"), *[F.lit(0.5 if k >> b & 1 else -0.5).alias(n) for b, n in enumerate(("dx", "dy", "dz"))]) for k in range(8)]))
    out = cells.withColumn("_k", at)
    xyz = {"x": (F.col("r") + F.col("_k.dx")) * edge, "y": (-F.col("i") + F.col("_k.dy")) * edge, "z": (F.col("c") + F.col("_k.dz")) * edge}
    return out.withColumn("corner", F.col("_k.corner")).withColumns(xyz).drop("_k")
