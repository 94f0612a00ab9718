"""The native grid format: int32 sizes, then for each cell in the order i, r, c a length and that many int32."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """Cells with a state as rows (file, i, r, c, room_id, cls)."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, data in zip(b["file"], b["content"]):
                values = np.frombuffer(data, dtype="<i4")
                _, nr, nc = values[:3].tolist()
                rows, at, cell = [], 3, 0
                while at < len(values):
                    n = int(values[at])
                    if n:
                        rows += [(file, cell // (nr * nc), cell // nc % nr, cell % nc, room, cls) for room, cls in decode_state(values[at + 1 : at + 1 + n].tolist())]
                    at, cell = at + 1 + n, cell + 1
                yield pd.DataFrame(rows, columns=["file", "i", "r", "c", "room_id", "cls"])

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content")
    return files.mapInPandas(f, "file string, i int, r int, c int, room_id int, cls int")


def decode_state(state: list[int]) -> list[tuple[int, int]]:
    """Pairs (room, class) of a state: the number of rooms, then for each its id, its number of classes and they."""
    out, at = [], 1
    for _ in range(state[0]):
        room, n = state[at : at + 2]
        out += [(room, cls) for cls in state[at + 2 : at + 2 + n]]
        at += 2 + n
    return out


def encode_state(rooms: list[tuple[int, list[int]]]) -> list[int]:
    return [len(rooms), *[x for room, classes in rooms for x in (room, len(classes), *classes)]]


def write(path: str, grid: DataFrame, size: tuple[int, int, int]) -> None:
    """A grid (i, r, c, room_id, cls) as one file of the given size; cells stream through the driver in order."""
    ni, nr, nc = size
    rooms = grid.groupBy("i", "r", "c", "room_id").agg(F.array_sort(F.collect_set("cls")).alias("classes"))
    cells = rooms.groupBy("i", "r", "c").agg(F.array_sort(F.collect_list(F.struct("room_id", "classes"))).alias("state"))
    with open(path, "wb") as out:
        out.write(struct.pack("<3i", ni, nr, nc))
        done = 0
        for row in cells.orderBy("i", "r", "c").toLocalIterator():
            at = (row["i"] * nr + row["r"]) * nc + row["c"]
            out.write(bytes(4 * (at - done)))
            state = encode_state([(s["room_id"], s["classes"]) for s in row["state"]])
            out.write(struct.pack(f"<{len(state) + 1}i", len(state), *state))
            done = at + 1
        out.write(bytes(4 * (ni * nr * nc - done)))
