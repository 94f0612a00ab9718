"""Queries over grids of all lineitem rows, whose ranges grow with the keys; tested by brute force, without SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrove.operators import components, evaluation, morphology, rays, segments, walls
from cellgrove.operators.neighbours import CELL
from cellgrove.plans import derived as d

QUERIES = {}
#: Keys that share a row or column of cells.
_KEYS = 20
_DISC, _BALL = morphology.disc(3), morphology.ball(2)


def query(f):
    """Register a query under its function's name."""
    QUERIES[f.__name__] = f
    return f


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of lineitem with its cell."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.withColumns({"i": F.floor((F.col("l_quantity") - 1) / 5).cast("int"), "r": F.expr(f"CAST(l_suppkey DIV {_KEYS} AS INT)"), "c": F.expr(f"CAST(l_partkey DIV {_KEYS} AS INT)")})


def cells(spark: SparkSession, sf_dir: str, odd: int | None = None) -> DataFrame:
    """Distinct cells (i, r, c) of all rows, or of the two grids that lines of odd and even numbers make."""
    rows = lines(spark, sf_dir)
    return (rows if odd is None else rows.where(F.col("l_linenumber") % 2 == odd)).select(*CELL).distinct()


def block(side: int):
    """A number from 1 for the block of side x side columns that holds a cell."""
    return F.expr(f"CAST(r DIV {side} AS BIGINT) * 2097152 + c DIV {side} + 1")


for _k in (4, 6, 8, 10, 18, 26):

    def _components(spark, sf, k=_k):
        return components.label_components(cells(spark, sf), k).select(*CELL, "label")

    _components.__name__ = f"whole_components_{_k}"
    query(_components)


@query
def whole_buffer_scores(spark, sf):
    out = evaluation.buffer_scores(cells(spark, sf, 1), cells(spark, sf, 0), 2, 0.05)
    return out.withColumns({n: F.round(n, 6) for n in ("completeness", "correctness", "accuracy")})


@query
def whole_dilated_disc(spark, sf):
    return morphology.dilated(cells(spark, sf), _DISC)


@query
def whole_closed_ball(spark, sf):
    return morphology.closed_within(cells(spark, sf, 1), _BALL, cells(spark, sf))


@query
def whole_largest_parts(spark, sf):
    v = components.label_components(cells(spark, sf), 26)
    z = v.withColumn("k", F.expr("(CAST(r AS BIGINT) DIV 10) * 2097152 + c DIV 10"))
    return segments.largest_parts(z, "k").select(*CELL, "k", "label")


@query
def whole_id_clusters(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    return segments.cluster_mapping(s.selectExpr("s_suppkey AS a", "s_suppkey * 7 + s_nationkey AS b"))


@query
def whole_slopes(spark, sf):
    n = lines(spark, sf).groupBy(*CELL).agg((F.min("l_orderkey") % 4 + 1).cast("int").alias("normal"))
    return rays.slope(n.where("normal IN (2, 4)"), 2, 1, 4, n.where("normal = 3"))


@query
def whole_grown_layers(spark, sf):
    n = lines(spark, sf).groupBy(*CELL).agg(F.min("l_orderkey").alias("k"))
    s = n.select(*CELL, F.when(F.col("k") % 7 == 0, -block(10)).otherwise(block(5)).alias("label"))
    return morphology.grown(s.where("label < 0"), s.where("label > 0"), 4)


@query
def whole_inherited_ids(spark, sf):
    flag, cls = F.concat("l_returnflag", "l_linestatus"), F.lit(-1)
    for k, f in enumerate(d._FLAGS):
        cls = F.when(flag == f, k).otherwise(cls)
    room = F.when(F.col("l_orderkey") % 13 == 0, block(5)).otherwise(0)
    return walls.inherited_ids(lines(spark, sf).select(*CELL, room.alias("room_id"), cls.alias("cls")).distinct())
