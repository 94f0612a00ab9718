"""Grids derived from the driver tables with integer arithmetic that every SQL engine shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells along i and along r in a strip, orders that share a column of cells, columns of a strip.
LAYERS, SIDE, ORDERS, ACROSS = 10, 20, 35, 4000
_FLAGS = ("AF", "NF", "NO", "RF", "AO", "RO")
#: Lines of a grid: every one, or those with odd or even numbers where a query compares two grids.
ALL, ODD, EVEN = 0, 1, 2


def _lines(spark: SparkSession, sf_dir: str, part: int) -> DataFrame:
    """Rows of lineitem with their cell. Strips of SIDE x ACROSS columns lie side by side along r, so the grid grows with the orders and keeps its density."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if part != ALL:
        rows = rows.where(F.col("l_linenumber") % 2 == part % 2)
    return rows.withColumns({
        "i": F.floor((F.col("l_quantity") - 1) / 5).cast("int"),
        "r": F.expr(f"CAST(l_suppkey % {SIDE} + l_orderkey DIV {ORDERS * ACROSS} * {SIDE} AS INT)"),
        "c": F.expr(f"CAST(l_orderkey DIV {ORDERS} % {ACROSS} AS INT)"),
    })


def _block(side: int):
    return F.expr(f"CAST(r DIV {side} * {ACROSS // side} + c DIV {side} + 1 AS INT)")


def cells(spark: SparkSession, sf_dir: str, part: int = ALL) -> DataFrame:
    """Distinct cells (i, r, c)."""
    return _lines(spark, sf_dir, part).select("i", "r", "c").distinct()


def grid(spark: SparkSession, sf_dir: str, part: int = ALL) -> DataFrame:
    """Cells with rooms and classes (i, r, c, room_id, cls); some cells have several of each. A block of columns has two rooms."""
    flag = F.concat("l_returnflag", "l_linestatus")
    cls = F.lit(-1)
    for k, f in enumerate(_FLAGS):
        cls = F.when(flag == f, k).otherwise(cls)
    room = 2 * _block(5) - F.when(F.col("l_orderkey") % 5 == 0, 1).otherwise(0)
    return _lines(spark, sf_dir, part).select("i", "r", "c", room.cast("int").alias("room_id"), cls.cast("int").alias("cls")).distinct()


def normals(spark: SparkSession, sf_dir: str, part: int = ALL) -> DataFrame:
    """Cells with a normal from 1 to 4."""
    return _lines(spark, sf_dir, part).groupBy("i", "r", "c").agg((F.min("l_orderkey") % 4 + 1).cast("int").alias("normal"))


def spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with a room id above or a transition space id below 0."""
    n = _lines(spark, sf_dir, ALL).groupBy("i", "r", "c").agg(F.min("l_orderkey").alias("k"))
    return n.select("i", "r", "c", F.when(F.col("k") % 7 == 0, -_block(10)).otherwise(_block(5)).alias("space_id"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points (id, x, y, z) from the first three components of vectors."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), *[F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")])


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles (id, x1 .. z3) from the first nine components."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), *[F.col("embedding")[3 * k + j].cast("double").alias(f"{a}{k + 1}") for k in range(3) for j, a in enumerate("xyz")])


def corner(filled: DataFrame) -> tuple[int, int]:
    """The largest r and c of a grid; -1 for none."""
    row = filled.agg(F.max("r"), F.max("c")).first()
    return tuple(-1 if x is None else x for x in row)


def empty(spark: SparkSession, filled: DataFrame) -> DataFrame:
    """Cells of the box from 0 to the grid's corner that it doesn't hold."""
    nr, nc = (x + 1 for x in corner(filled))
    every = spark.range(LAYERS * nr * nc).selectExpr(f"CAST(id DIV {nr * nc or 1} AS INT) AS i", f"CAST(id DIV {nc or 1} % {nr or 1} AS INT) AS r", f"CAST(id % {nc or 1} AS INT) AS c")
    return every.join(filled.select("i", "r", "c").distinct(), ["i", "r", "c"], "left_anti")


# the same relations for the oracle
def _sql_lines(part: int) -> str:
    rows = "lineitem" if part == ALL else f"lineitem WHERE l_linenumber % 2 = {part % 2}"
    return f"(SELECT *, CAST(floor((l_quantity - 1) / 5) AS INTEGER) AS i, CAST(l_suppkey % {SIDE} + l_orderkey // {ORDERS * ACROSS} * {SIDE} AS INTEGER) AS r, CAST(l_orderkey // {ORDERS} % {ACROSS} AS INTEGER) AS c FROM {rows})"


def _sql_block(side: int) -> str:
    return f"(r // {side} * {ACROSS // side} + c // {side} + 1)"


def sql_cells(part: int = ALL) -> str:
    return f"(SELECT DISTINCT i, r, c FROM {_sql_lines(part)})"


def sql_grid(part: int = ALL) -> str:
    whens = " ".join(f"WHEN '{f}' THEN {k}" for k, f in enumerate(_FLAGS))
    return f"(SELECT DISTINCT i, r, c, CAST(2 * {_sql_block(5)} - CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS room_id, CAST(CASE l_returnflag || l_linestatus {whens} ELSE -1 END AS INTEGER) AS cls FROM {_sql_lines(part)})"


def sql_normals(part: int = ALL) -> str:
    return f"(SELECT i, r, c, CAST(min(l_orderkey) % 4 + 1 AS INTEGER) AS normal FROM {_sql_lines(part)} GROUP BY i, r, c)"


def sql_spaces() -> str:
    return f"(SELECT i, r, c, CAST(CASE WHEN min(l_orderkey) % 7 = 0 THEN -{_sql_block(10)} ELSE {_sql_block(5)} END AS INTEGER) AS space_id FROM {_sql_lines(ALL)} GROUP BY i, r, c)"


def sql_points() -> str:
    return "(SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"


def sql_triangles() -> str:
    parts = ", ".join(f"CAST(embedding[{3 * k + j + 1}] AS DOUBLE) AS {a}{k + 1}" for k in range(3) for j, a in enumerate("xyz"))
    return f"(SELECT vec_id AS id, {parts} FROM embeddings)"


def sql_empty(filled: str) -> str:
    every = f"(SELECT CAST(i AS INTEGER) AS i, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c FROM (SELECT unnest(range({LAYERS})) AS i), (SELECT unnest(range(max(r) + 1)) AS r FROM {filled}), (SELECT unnest(range(max(c) + 1)) AS c FROM {filled}))"
    return f"(SELECT i, r, c FROM {every} EXCEPT SELECT i, r, c FROM {filled})"


def sql_offsets(offsets: list[tuple[int, int, int]]) -> str:
    return "(VALUES " + ", ".join(map(str, offsets)) + ") o(di, dr, dc)"


SQL_ID = "(CAST(i AS BIGINT) * 4398046511104 + r * 2097152 + c)"


def sql_labels(cells_sql: str, offsets: list[tuple[int, int, int]], condition: str = "TRUE") -> str:
    """CTEs v, e, low and labelled (v.*, label): the least vid that neighbours a, b of v that meet a condition hand on."""
    return f"""v AS MATERIALIZED (SELECT *, {SQL_ID} AS vid FROM {cells_sql}),
      e AS MATERIALIZED (SELECT a.vid AS va, b.vid AS vb FROM v a, {sql_offsets(offsets)}, v b
            WHERE b.i = a.i + di AND b.r = a.r + dr AND b.c = a.c + dc AND {condition}),
      low(vid, label) USING KEY (vid) AS (SELECT vid, vid FROM v UNION SELECT x.vid, min(x.label) FROM (
            SELECT e.va AS vid, low.label FROM low JOIN e ON e.vb = low.vid
            UNION ALL SELECT p.vid, q.label FROM recurring.low AS p JOIN recurring.low AS q ON q.vid = p.label) x JOIN recurring.low AS k ON k.vid = x.vid WHERE x.label < k.label GROUP BY x.vid),
      labelled AS (SELECT v.*, low.label FROM v JOIN low ON v.vid = low.vid)"""
