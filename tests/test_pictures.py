"""Pictures and reports."""

import struct
import zlib

import numpy as np

from cellgrove.sources import pictures, ply, reports


def test_png_holds_its_pixels():
    pixels = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    data = pictures.png(pixels)
    n, = struct.unpack(">I", data[33:37])
    raw = zlib.decompress(data[41 : 41 + n])
    assert data[16:24] == struct.pack(">II", 3, 2) and raw == b"".join(b"\0" + p.tobytes() for p in pixels)


def test_cubes_and_sections(spark, tmp_path):
    cells = spark.createDataFrame([(0, 1, 2, 3), (1, 0, 0, 4), (1, 1, 1, 77)], "i int, r int, c int, shown int")
    color = pictures.colored(cells, "shown", pictures.CLASS_COLORS)
    assert color.count() == 2
    cut = pictures.section(color, "i", 0, (2, 3))
    assert tuple(cut[1, 2]) == (0, 255, 0) and cut.sum() == 255
    pictures.write_cubes(str(tmp_path / "a.ply"), color)
    xyz, faces = ply.decode((tmp_path / "a.ply").read_bytes())
    assert xyz.shape == (16, 3) and faces.shape == (24, 3) and faces.max() == 15


def test_labels_have_their_own_colors():
    assert len({pictures.label_color(k) for k in range(1, 200)}) > 190


def test_metric_rows_and_lines(spark):
    s = spark.createDataFrame([(0, 50.0, 25.0), (3, 100.0, 75.0)], "cls int, precision double, recall double")
    rows = sorted(map(tuple, reports.metric_table(s, "cls").collect()))
    assert rows[0] == ("precision", 0, 50.0) and len(rows) == 4
    v = spark.createDataFrame([(0, 1), (3, 3), (1, 50)], "cls int, n long")
    assert reports.weighted_mean(s, v, "recall").first()[0] == 62.5
    b = spark.createDataFrame([(0, 0.5, 0.25, None)], "step int, completeness double, correctness double, accuracy double")
    assert reports.buffer_lines(b).first()["line"] == "0; 0.5000; 0.2500; 0.0000"
