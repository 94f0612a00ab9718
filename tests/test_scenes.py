"""Small scenes with answers by hand, and files that come back as they were written."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.operators import columns, components, evaluation, morphology, reconstruct, segments, voxelize
from cellgrove.plans.params import Params
from cellgrove.sources import grids, names, ply, points, reports
from cellgrove.streaming.occupancy import point_counts


def cells(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"i int, r int, c int{extra}")


def box_mesh(lo, hi):
    """Corners and outward triangles of a box."""
    v = np.array([[(lo, hi)[k >> b & 1][b] for b in range(3)] for k in range(8)], dtype=float)
    f = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]
    return v, np.array(f)


def test_box_mesh_has_ceiling_floor_and_walls(spark):
    v, f = box_mesh((0, 0, 0), (1, 1, 1))
    vertices = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(v)], "v long, x double, y double, z double")
    faces = spark.createDataFrame([(k, *map(int, t)) for k, t in enumerate(f)], "f long, v1 long, v2 long, v3 long")
    t = voxelize.triangles_of(vertices, faces)
    grid = voxelize.grid_of(voxelize.bounds(vertices), 0.25)
    n = voxelize.mesh_normals(t, grid, 0.25)
    middle = n.where("r BETWEEN 2 AND 3 AND c BETWEEN 2 AND 3").groupBy("normal").agg(F.collect_set("i").alias("i")).collect()
    by = {r["normal"]: set(r["i"]) for r in middle}
    assert set(by) == {1, 2} and max(by[1]) < min(by[2])
    sides = n.where("i = 3").select("normal").distinct().collect()
    assert [r["normal"] for r in sides] == [3]


def test_components_keep_apart_what_a_condition_parts(spark):
    c = cells(spark, [(0, 0, 0, 1), (0, 0, 1, 1), (0, 0, 2, 2), (0, 5, 5, 2)], ", kind int")
    assert components.label_components(c, 4).select("label").distinct().count() == 2
    assert components.label_components(c, 4, same=["kind"]).select("label", "kind").distinct().count() == 3
    assert components.label_components(c, 4, F.col("kind") == F.col("n_kind")).select("label").distinct().count() == 3


def test_long_chain_is_one_component(spark):
    c = cells(spark, [(0, 0, k) for k in range(300)])
    assert [r["label"] for r in components.label_components(c, 4).select("label").distinct().collect()] == [0]


def test_empty_tables(spark):
    none = cells(spark, [])
    assert components.label_components(none, 6).count() == 0
    assert columns.runs(none).count() == 0
    assert morphology.eroded(none, morphology.disc(2)).count() == 0
    assert morphology.grown(cells(spark, [], ", label int"), none, 4).count() == 0


def test_grid_compared_with_itself_is_perfect(spark):
    g = cells(spark, [(0, r, c, 1 + r // 2, r % 3) for r in range(4) for c in range(4)], ", room_id int, cls int")
    m = evaluation.mutual_mapping(evaluation.weighted_mapping(g, g))
    assert m.count() == 2
    s = evaluation.room_scores(g, g, m).first()
    assert (s["precision"], s["recall"], s["f1"]) == (100, 100, 100)
    assert all(r["precision"] == r["recall"] == 100 for r in evaluation.class_scores(g, g).collect())
    moved = g.withColumn("c", F.col("c") + 1)
    for r in evaluation.class_scores(g, moved).collect():
        assert r["near_precision"] > r["precision"]


def test_enclosed_cell_is_filled_for_its_room(spark):
    ring = [(0, r, c, 7, 4) for r in range(3) for c in range(3) if (r, c) != (1, 1)]
    g = cells(spark, ring, ", room_id int, cls int")
    out = reconstruct.enclosed_filled(g, cells(spark, [(0, 1, 1)]), (0, 0), (2, 2)).collect()
    assert [tuple(r) for r in out] == [(0, 1, 1, 7, 1)]


def test_dead_end_joins_its_room_and_lonely_one_goes(spark):
    s = cells(spark, [(0, 0, 0, 1), (0, 0, 1, -1), (0, 9, 9, -2)], ", space_id int")
    assert sorted(tuple(r) for r in segments.without_dead_ends(s).select("i", "r", "c", "space_id").collect()) == [(0, 0, 0, 1), (0, 0, 1, 1)]


def test_parameters_in_voxels():
    p = Params(resolution=0.05)
    assert (p.voxels(0.18), p.area(0.5), round(p.diagonal, 4)) == (4, 200, 0.0707)


@pytest.mark.parametrize("encoding", list(ply.ENCODINGS))
def test_ply_round_trip(encoding, spark, tmp_path):
    v, f = box_mesh((0, 0, 0), (1.5, 2, 3))
    (tmp_path / "a.ply").write_bytes(ply.encode(v, f, encoding=encoding, extra={"q": np.arange(8)}))
    got = ply.read_vertices(spark, str(tmp_path)).orderBy("v").select("x", "y", "z").toPandas().to_numpy()
    assert np.allclose(got, v)
    assert (ply.read_faces(spark, str(tmp_path)).orderBy("f").select("v1", "v2", "v3").toPandas().to_numpy() == f).all()
    assert (ply.decode((tmp_path / "a.ply").read_bytes(), flip=True)[1] == f[:, [0, 2, 1]]).all()


def test_ply_errors():
    with pytest.raises(ValueError):
        ply.parse_header(b"ply\nformat ascii 1.0\nelement vertex 1\nproperty short x\nend_header\n")
    with pytest.raises(ValueError):
        ply.decode(b"ply\nformat ascii 1.0\nelement vertex 0\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nend_header\n4 0 1 2 3\n")


def test_native_grid_round_trip(spark, tmp_path):
    g = cells(spark, [(0, 0, 1, 2, 3), (0, 0, 1, 2, 4), (0, 0, 1, -1, 1), (1, 2, 2, 5, 0)], ", room_id int, cls int")
    grids.write(str(tmp_path / "g.bin"), g, (2, 3, 3))
    back = grids.read(spark, str(tmp_path / "g.bin")).select("i", "r", "c", "room_id", "cls")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, g.collect()))


def test_point_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1.5 2 3 9\n4 5 6 9\n")
    assert points.read(spark, str(tmp_path / "a.txt")).orderBy("x").first()[:] == (1.5, 2.0, 3.0)
    head = bytearray(227)
    head[:4], head[24:26] = b"LASF", bytes([1, 2])
    struct.pack_into("<I", head, 96, 227)
    head[104] = 0
    struct.pack_into("<H", head, 105, 20)
    struct.pack_into("<I", head, 107, 2)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 10, 20, 30)
    body = b"".join(struct.pack("<3i8x", *p) for p in ((100, 200, 300), (0, 0, 0)))
    (tmp_path / "a.las").write_bytes(bytes(head) + body)
    assert sorted(map(tuple, points.read(spark, str(tmp_path / "a.las")).collect())) == [(10.0, 20.0, 30.0), (11.0, 22.0, 33.0)]
    with pytest.raises(ValueError):
        points.read(spark, "a.xyz")


def test_names_of_ground_truth_files(spark):
    d = spark.createDataFrame([("R12_WO_1.ply",), ("T3R_F.ply",), ("R1_IOx.ply",), ("x_C.ply",)], "n string")
    n = F.col("n")
    out = d.select(names.is_ground_truth(n), names.room_id(n), names.class_value(n), names.is_ramp(n)).collect()
    assert [tuple(r) for r in out] == [(True, 12, 5, False), (True, -3, 3, True), (True, 1, 2, False), (False, None, 0, False)]


def test_sweep_table(spark):
    r = spark.createDataFrame([("p", 0.05, 0.0, 99.123), ("p", 0.05, 10.0, 98.0)], "metric string, resolution double, rotation double, value double")
    t = reports.sweep_table(r)
    assert t.columns == ["metric", "Res. 0.05m / Rot. 0.00°", "Res. 0.05m / Rot. 10.00°"] and t.first()[1] == "99.12"


def test_stream_counts_like_the_batch(spark, tmp_path):
    rows = [(k * 0.1, k % 3 * 0.1, 0.05) for k in range(30)]
    d = spark.createDataFrame(rows, "x double, y double, z double")
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = point_counts(s, (0.0, 0.0, 0.0), 0.25).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    batch = point_counts(d, (0.0, 0.0, 0.0), 0.25)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))
