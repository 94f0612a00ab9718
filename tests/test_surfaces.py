"""Distances, rays and labels of triangles, and the vertical sweep, against plain versions."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from cellgrove.operators import surfaces, sweep

CORNERS = [f"{a}{k}" for k in "123" for a in "xyz"]


def test_triangle_distance_is_the_least_over_the_triangle():
    rng = np.random.default_rng(1)
    p, t = rng.normal(size=(60, 3)), rng.normal(size=(60, 3, 3))
    t[0, 2] = t[0, 1]
    steps = np.array([(a, b) for a in np.linspace(0, 1, 150) for b in np.linspace(0, 1, 150) if a + b <= 1])
    for got, q, (a, b, c) in zip(surfaces.triangle_distance(p, t), p, t):
        on = a + steps[:, :1] * (b - a) + steps[:, 1:] * (c - a)
        least = np.linalg.norm(on - q, axis=1).min()
        assert got <= least + 1e-9 and least - got < 0.03


def test_nearest_triangles_within_reach(spark):
    rng = np.random.default_rng(2)
    t, p = rng.uniform(0, 3, size=(40, 3, 1)) + rng.uniform(0, 0.5, size=(40, 3, 3)), rng.uniform(-0.5, 4, size=(50, 3))
    triangles = spark.createDataFrame([(k, *map(float, x.ravel())) for k, x in enumerate(t)], "triangle_id long, " + ", ".join(f"{c} double" for c in CORNERS))
    points = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(p)], "id long, x double, y double, z double")
    got = {r["id"]: (r["triangle_id"], r["distance"]) for r in surfaces.nearest_triangles(points, triangles, 0.6).collect()}
    for k, q in enumerate(p):
        far = surfaces.triangle_distance(np.repeat(q[None], 40, axis=0), t)
        best = int(far.argmin())
        assert got[k] == ((best, far[best]) if far[best] <= 0.6 else (None, None)) or abs(got[k][1] - far[best]) < 1e-9


def test_rays(spark):
    one = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, 0.0, 1.0, 0.0, 1.0, 1.0)], ", ".join(f"{c} double" for c in CORNERS))
    lit = lambda *v: [F.lit(float(x)) for x in v]
    hit = lambda o, v: one.select(surfaces.ray_at_triangle(lit(*o), lit(*v)).alias("t")).first()["t"]
    assert hit((0.2, 0.2, 0), (0, 0, 1)) == 1 and hit((0.9, 0.9, 0), (0, 0, 1)) is None and hit((0, 0, 0), (1, 0, 0)) is None
    box = lambda o, v: one.select(surfaces.ray_hits_box(lit(*o), lit(*v), lit(0, 0, 0), lit(1, 1, 1)).alias("b")).first()["b"]
    assert box((0.5, 0.5, -3), (0, 0, 1)) and not box((2, 0.5, -3), (0, 0, 1)) and box((-1, -1, -1), (1, 1, 1)) and not box((-1, 3, 0.5), (1, 0.1, 0))


def test_labels_of_test_triangles(spark):
    rows = [
        (1, 0.0, 0.1, 2, 5, False, 1.0), (1, 0.0, 0.5, 0, 6, False, 1.0),
        (2, -1.0, 0.2, 0, 7, True, 1.0), (2, -1.0, 0.2, 3, 8, False, 9.0),
        (3, 1.0, 0.2, 0, 7, False, 1.0), (3, 1.0, 0.2, 3, 8, True, 1.0),
        (4, 0.0, 0.2, 0, 7, False, 1.0), (4, 0.0, 0.2, 3, 8, False, 2.0), (4, 0.0, 0.2, 2, 9, False, 5.0),
        (5, 0.0, 0.2, 2, 4, False, 1.0), (5, 0.0, 0.2, 3, 8, False, 1.0),
    ]
    hits = spark.createDataFrame(rows, "id long, ny double, distance double, cls int, room_id int, is_ramp boolean, area double")
    out = surfaces.triangle_label(hits).orderBy("id").collect()
    assert [tuple(r) for r in out] == [(1, 2, 5, False), (2, 0, 7, True), (3, 3, 8, True), (4, 4, 8, False), (5, 3, 8, False)]


def test_sweep_of_one_column(spark):
    # a ceiling, two empty cells, an object, a floor; beside it a wall column with an opening
    grid = spark.createDataFrame([(1, 0, 0, 1, 0), (5, 0, 0, 1, 3), (1, 0, 1, 1, 0), (1, 0, 1, 1, 4), (4, 0, 1, 1, 3)], "i int, r int, c int, room_id int, cls int")
    normals = spark.createDataFrame([(4, 0, 0, 3), (2, 0, 1, 3)], "i int, r int, c int, normal int")
    spans = spark.createDataFrame([(1, 0, 0, 2, 5), (1, 0, 1, 2, 4)], "room_id int, r int, c int, top int, bottom int")
    got = {(r["c"], r["i"]): r["mask"] for r in sweep.swept(spans, grid, normals).collect()}
    assert got == {(0, 2): sweep.EI, (0, 3): sweep.EI, (0, 4): sweep.IO, (0, 5): sweep.FL, (1, 2): sweep.W, (1, 3): sweep.WO, (1, 4): sweep.FL | sweep.W}


def test_sweep_ends_where_another_room_begins(spark):
    grid = spark.createDataFrame([(1, 0, 0, 1, 0), (3, 0, 0, 2, 1)], "i int, r int, c int, room_id int, cls int")
    none = spark.createDataFrame([], "i int, r int, c int, normal int")
    spans = spark.createDataFrame([(1, 0, 0, 2, 5)], "room_id int, r int, c int, top int, bottom int")
    got = {r["i"]: r["mask"] for r in sweep.swept(spans, grid, none).collect()}
    assert got == {2: sweep.EI, 3: sweep.FL}


def test_every_pair_of_classes_has_one_result(spark):
    cases = list(itertools.product(range(64), (0, 1, 2, 4, 8, 16, 24, 32), (0, 1, 2), (False, True)))
    d = spark.createDataFrame(cases, "above int, own int, open int, occ boolean")
    out = d.select("above", "own", sweep.next_mask(F.col("above"), F.col("own"), F.col("open"), F.col("occ")).alias("m")).collect()
    assert all(r["m"] is not None for r in out)
    assert all(r["m"] == r["own"] for r in out if r["above"] & sweep.FL or not r["above"])
