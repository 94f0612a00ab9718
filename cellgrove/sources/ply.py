"""PLY meshes and point clouds: ascii, binary little-endian and binary big-endian."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: property types of the format
TYPES = {"uchar": "u1", "int": "i4", "float": "f4", "double": "f8"}
ENCODINGS = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}


@dataclass
class Header:
    """What stands before end_header: the encoding, counts, vertex properties and the size in bytes."""

    encoding: str = "ascii"
    vertices: int = 0
    faces: int = 0
    properties: list[tuple[str, str]] = field(default_factory=list)
    size: int = 0


def parse_header(data: bytes) -> Header:
    """The header of a file; property types other than uchar, int, float and double are errors."""
    out, section, at = Header(), "", 0
    if not data.startswith(b"ply"):
        raise ValueError("not a PLY file")
    while True:
        end = data.index(b"\n", at)
        words = data[at:end].decode("ascii").split()
        at = end + 1
        match words:
            case ["format", encoding, *_]:
                if encoding not in ENCODINGS:
                    raise ValueError(f"unknown encoding {encoding}")
                out.encoding = encoding
            case ["element", "vertex", n]:
                out.vertices, section = int(n), "vertex"
            case ["element", "face", n]:
                out.faces, section = int(n), "face"
            case ["property", kind, name] if section == "vertex":
                if kind not in TYPES:
                    raise ValueError(f"unknown property type {kind}")
                out.properties.append((name, kind))
            case ["end_header"]:
                out.size = at
                return out


def decode(data: bytes, names: tuple[str, str, str] = ("x", "y", "z"), flip: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates (n, 3) and faces (m, 3) of a file; flip swaps the second and third vertex of every face."""
    head = parse_header(data)
    cols = [n for n, _ in head.properties]
    pick = [cols.index(n) for n in names]
    if head.encoding == "ascii":
        lines = data[head.size :].decode("ascii").split("\n")
        xyz = np.array([[float(v) for v in line.split()] for line in lines[: head.vertices]], dtype=np.float64).reshape(head.vertices, -1)[:, pick] if head.vertices else np.zeros((0, 3))
        rows = [[int(v) for v in line.split()] for line in lines[head.vertices : head.vertices + head.faces]]
        if any(r[0] != 3 or len(r) < 4 for r in rows):
            raise ValueError("a face hasn't three vertices")
        faces = np.array([r[1:4] for r in rows], dtype=np.int64).reshape(-1, 3)
    else:
        order = ENCODINGS[head.encoding]
        kind = np.dtype([(n, order + TYPES[t]) for n, t in head.properties])
        v = np.frombuffer(data, dtype=kind, count=head.vertices, offset=head.size)
        xyz = np.stack([v[n].astype(np.float64) for n in names], axis=1)
        f = np.frombuffer(data, dtype=np.dtype([("n", "u1"), ("v", order + "i4", 3)]), count=head.faces, offset=head.size + kind.itemsize * head.vertices)
        if (f["n"] != 3).any():
            raise ValueError("a face hasn't three vertices")
        faces = f["v"].astype(np.int64)
    return xyz, faces[:, [0, 2, 1]] if flip else faces


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.xxhash64("path").alias("mesh_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content")


def read_vertices(spark: SparkSession, path: str, glob: str = "*.ply", names: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """mesh_id, file, v, x, y, z of the PLY files of a folder, or of one file."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for m, file, data in zip(b["mesh_id"], b["file"], b["content"]):
                xyz, _ = decode(data, names)
                yield pd.DataFrame({"mesh_id": m, "file": file, "v": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})

    return _files(spark, path, glob).mapInPandas(f, "mesh_id long, file string, v long, x double, y double, z double")


def read_faces(spark: SparkSession, path: str, glob: str = "*.ply", flip: bool = False) -> DataFrame:
    """mesh_id, file, f, v1, v2, v3 of the PLY files of a folder, or of one file."""

    def g(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for m, file, data in zip(b["mesh_id"], b["file"], b["content"]):
                faces = decode(data, tuple(n for n, _ in parse_header(data).properties[:3]), flip)[1]
                yield pd.DataFrame({"mesh_id": m, "file": file, "f": np.arange(len(faces)), "v1": faces[:, 0], "v2": faces[:, 1], "v3": faces[:, 2]})

    return _files(spark, path, glob).mapInPandas(g, "mesh_id long, file string, f long, v1 long, v2 long, v3 long")


def encode(xyz: np.ndarray, faces: np.ndarray, colors: np.ndarray | None = None, extra: dict[str, np.ndarray] | None = None, encoding: str = "binary_little_endian", single: bool = True) -> bytes:
    """A file of vertices with colours (grey unless given), extra float properties and triangles."""
    extra = extra or {}
    colors = np.full((len(xyz), 3), 128, dtype=np.uint8) if colors is None else colors
    kind = "float" if single else "double"
    head = ["ply", f"format {encoding} 1.0", f"element vertex {len(xyz)}", *[f"property {kind} {a}" for a in "xyz"]]
    head += [f"property uchar {c}" for c in ("red", "green", "blue")] + [f"property float {n}" for n in extra]
    head += [f"element face {len(faces)}", "property list uchar int vertex_indices", "end_header", ""]
    start = "\n".join(head).encode("ascii")
    if encoding == "ascii":
        rows = [" ".join([*map(repr, map(float, p)), *map(str, map(int, c)), *[repr(float(v[k])) for v in extra.values()]]) for k, (p, c) in enumerate(zip(xyz, colors))]
        rows += [f"3 {a} {b} {c}" for a, b, c in faces]
        return start + "".join(r + "\n" for r in rows).encode("ascii")
    order = ENCODINGS[encoding]
    v = np.zeros(len(xyz), dtype=[*[(a, order + ("f4" if single else "f8")) for a in "xyz"], ("rgb", "u1", 3), *[(n, order + "f4") for n in extra]])
    for k, a in enumerate("xyz"):
        v[a] = xyz[:, k]
    v["rgb"] = colors
    for n, x in extra.items():
        v[n] = x
    f = np.zeros(len(faces), dtype=[("n", "u1"), ("v", order + "i4", 3)])
    f["n"], f["v"] = 3, faces
    return start + v.tobytes() + f.tobytes()


def write(path: str, vertices: DataFrame, faces: DataFrame, encoding: str = "binary_little_endian", single: bool = True) -> None:
    """One PLY file of a mesh (v from 0, x, y, z; f, v1, v2, v3) of a size that one file, and so the driver, holds."""
    v = vertices.orderBy("v").toPandas()
    f = faces.orderBy("f").toPandas()
    colors = v[["red", "green", "blue"]].to_numpy(dtype=np.uint8) if "red" in v else None
    data = encode(v[["x", "y", "z"]].to_numpy(), f[["v1", "v2", "v3"]].to_numpy(), colors, None, encoding, single)
    with open(path, "wb") as out:
        out.write(data)
