"""Point clouds by the ending of their files: .ply, .txt and uncompressed .las."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrove.operators.voxelize import bounds, rotated
from cellgrove.sources import ply


def read_txt(spark: SparkSession, path: str) -> DataFrame:
    """Lines `x y z ...`, single spaces: the first three columns."""
    parts = F.split("value", " ")
    return spark.read.text(path).select(*[parts[k].cast("double").alias(a) for k, a in enumerate("xyz")])


def decode_las(data: bytes) -> np.ndarray:
    """Coordinates of an uncompressed LAS 1.x file: scaled integers plus offset."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    start, = struct.unpack_from("<I", data, 96)
    kind, length = data[104], struct.unpack_from("<H", data, 105)[0]
    if kind & 0x80:
        raise ValueError("compressed LAS needs a native decoder")
    n, = struct.unpack_from("<I", data, 107)
    if n == 0 and data[25] >= 4:
        n, = struct.unpack_from("<Q", data, 247)
    scale, offset = np.array(struct.unpack_from("<3d", data, 131)), np.array(struct.unpack_from("<3d", data, 155))
    rows = np.frombuffer(data, dtype=np.dtype({"names": ["p"], "formats": [("<i4", 3)], "offsets": [0], "itemsize": length}), count=n, offset=start)
    return rows["p"] * scale + offset


def read_las(spark: SparkSession, path: str) -> DataFrame:
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                yield pd.DataFrame(decode_las(data), columns=list("xyz"))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(f, "x double, y double, z double")


def read(spark: SparkSession, path: str, rotate: bool = False) -> DataFrame:
    """x, y, z of a file; rotate turns it by 90 degrees about x at its centroid, from z up to y up."""
    end = path.rsplit(".", 1)[-1].lower()
    readers = {"ply": lambda: ply.read_vertices(spark, path).select("x", "y", "z"), "txt": lambda: read_txt(spark, path), "las": lambda: read_las(spark, path)}
    if end not in readers:
        raise ValueError(f"no reader for {end}")
    out = readers[end]()
    return rotated(out, 90.0, (1.0, 0.0, 0.0), bounds(out)) if rotate else out
