"""Distances, rays and labels between triangles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgrove.operators.voxelize import XYZ, normal_sql
from cellgrove.plans.params import CEILING, FLOOR, INTERIOR_OBJECT, WALL, Params

_CORNERS = [f"{a}{k}" for k in "123" for a in XYZ]


def triangle_distance(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Distances of points (n, 3) to triangles (n, 3, 3): to the plane where the foot lies inside, else to the nearest edge."""
    a, b, c = t[:, 0], t[:, 1], t[:, 2]
    n = np.cross(b - a, c - a)
    square = (n * n).sum(axis=1)
    flat = square > 0
    height = np.divide(((p - a) * n).sum(axis=1), np.sqrt(square), out=np.zeros(len(p)), where=flat)
    foot = p - np.divide(height, np.sqrt(square), out=np.zeros(len(p)), where=flat)[:, None] * n
    inside = flat.copy()
    best = np.full(len(p), np.inf)
    for u, v in ((a, b), (b, c), (c, a)):
        edge = v - u
        inside &= (np.cross(edge, foot - u) * n).sum(axis=1) >= 0
        length = (edge * edge).sum(axis=1)
        at = np.clip(np.divide(((p - u) * edge).sum(axis=1), length, out=np.zeros(len(p)), where=length > 0), 0, 1)
        best = np.minimum(best, np.linalg.norm(p - u - at[:, None] * edge, axis=1))
    return np.where(inside, np.abs(height), best)


@F.pandas_udf(T.DoubleType())
def distance_to_triangle(point: pd.Series, triangle: pd.Series) -> pd.Series:
    """Arrays of 3 and of 9 coordinates to a distance."""
    p, t = np.stack(point.to_numpy()), np.stack(triangle.to_numpy()).reshape(-1, 3, 3)
    return pd.Series(triangle_distance(p, t))


def nearest_triangles(points: DataFrame, triangles: DataFrame, reach: float) -> DataFrame:
    """Points (id, x, y, z) with the nearest triangle (triangle_id, x1 .. z3) within reach: triangle_id and distance.

    Triangles are dealt to the cells of edge `reach` that their boxes, widened
    by it, meet; a point looks in its own cell only. Ties go to the least id.
    """
    cell = lambda e: F.floor(e / reach).cast("long")
    t = triangles.select("triangle_id", *_CORNERS)
    for a in XYZ:
        ends = [F.col(f"{a}{k}") for k in "123"]
        t = t.withColumn(f"c{a}", F.explode(F.sequence(cell(F.least(*ends) - reach), cell(F.greatest(*ends) + reach))))
    p = points.select("id", *XYZ, *[cell(F.col(a)).alias(f"c{a}") for a in XYZ])
    both = p.join(t, [f"c{a}" for a in XYZ])
    d = distance_to_triangle(F.array(*XYZ), F.array(*_CORNERS))
    near = both.select("id", "triangle_id", d.alias("distance")).where(F.col("distance") <= reach)
    best = near.groupBy("id").agg(F.min(F.struct("distance", "triangle_id")).alias("b")).select("id", "b.triangle_id", "b.distance")
    return points.select("id").join(best, "id", "left")


def ray_hits_box(origin: list[Column], direction: list[Column], low: list[Column], high: list[Column]) -> Column:
    """Whether a line meets a box: the slabs' intervals have a common part."""
    near, far, outside = F.lit(-math.inf), F.lit(math.inf), F.lit(False)
    for o, v, a, b in zip(origin, direction, low, high):
        t1, t2 = F.try_divide(a - o, v), F.try_divide(b - o, v)
        outside = outside | ((v == 0) & ((o < a) | (o > b)))
        near = F.greatest(near, F.when(v == 0, F.lit(-math.inf)).otherwise(F.least(t1, t2)))
        far = F.least(far, F.when(v == 0, F.lit(math.inf)).otherwise(F.greatest(t1, t2)))
    return ~outside & (near <= far)


def ray_at_triangle(origin: list[Column], direction: list[Column]) -> Column:
    """The distance along a unit line at which it meets the triangle in columns x1 .. z3; null without a hit."""
    e1 = [F.col(f"{a}2") - F.col(f"{a}1") for a in XYZ]
    e2 = [F.col(f"{a}3") - F.col(f"{a}1") for a in XYZ]
    s = [o - F.col(f"{a}1") for o, a in zip(origin, XYZ)]
    cross = lambda u, v: [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    h, q = cross(direction, e2), cross(s, e1)
    det = dot(e1, h)
    u, v, t = F.try_divide(dot(s, h), det), F.try_divide(dot(direction, q), det), F.try_divide(dot(e2, q), det)
    return F.when((F.abs(det) > 1e-12) & (u >= 0) & (v >= 0) & (u + v <= 1), t)


def triangle_label(hits: DataFrame, params: Params = Params()) -> DataFrame:
    """The label of each test triangle from its hits (id, ny: y of its unit normal, distance, cls, room_id, is_ramp, area).

    The nearest hits count. One alone gives its label. Of several, objects are
    left out; then a ceiling if the triangle looks down, a floor if it looks
    up, else the largest triangle's room as wall.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("id")
    near = hits.withColumn("_m", F.min("distance").over(w)).where("distance = _m").withColumn("_n", F.count("*").over(w))
    near = near.where((F.col("_n") == 1) | (F.col("cls") != INTERIOR_OBJECT)).withColumn("_n", F.count("*").over(w))
    down = F.max((F.col("cls") == CEILING)).over(w) & (-F.col("ny") > math.cos(math.radians(params.down_angle)))
    up = ~down & F.max((F.col("cls") == FLOOR)).over(w) & (F.col("ny") > math.cos(math.radians(params.up_angle)))
    target = F.when(F.col("_n") == 1, F.col("cls")).when(down, CEILING).when(up, FLOOR).otherwise(WALL)
    fits = near.withColumn("_t", target).where((F.col("_n") == 1) | (F.col("_t") == WALL) | (F.col("cls") == F.col("_t")))
    best = F.min(F.struct(-F.col("area"), "room_id", "is_ramp", "_t")).alias("b")
    return fits.groupBy("id").agg(best).select("id", F.col("b._t").alias("cls"), "b.room_id", "b.is_ramp")


def unit_normals(triangles: DataFrame) -> DataFrame:
    """Triangles with nx, ny, nz of length 1 and area; null normals for those without an area."""
    n = [F.expr(e) for e in normal_sql()]
    length = F.sqrt(sum((x * x for x in n), F.lit(0.0)))
    return triangles.withColumns({f"n{a}": F.try_divide(x, length) for a, x in zip(XYZ, n)} | {"area": length / 2})
