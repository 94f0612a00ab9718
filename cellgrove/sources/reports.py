"""Tables of metrics as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sweep_table(results: DataFrame) -> DataFrame:
    """Rows (metric, resolution, rotation, value) as a column for each pair of parameters, values with two decimals."""
    head = F.format_string("Res. %.2fm / Rot. %.2f°", "resolution", "rotation")
    return results.withColumn("_h", head).groupBy("metric").pivot("_h").agg(F.format_string("%.2f", F.first("value")))


def write_table(table: DataFrame, path: str) -> None:
    """A folder of one CSV file with semicolons; tables of metrics are small."""
    table.orderBy(table.columns[0]).coalesce(1).write.mode("overwrite").option("header", True).option("sep", ";").csv(path)


def mapping_lines(mapping: DataFrame, ramps: DataFrame) -> DataFrame:
    """A weighted room mapping as text lines in the order of ids."""
    from cellgrove.operators.evaluation import room_label

    ramp = lambda n: ramps.select(F.col("room_id").alias(n), F.lit(True).alias(f"{n}_ramp")).distinct()
    both = mapping.join(ramp("from_id"), "from_id", "left").join(ramp("to_id"), "to_id", "left")
    label = lambda n: room_label(F.col(n), F.coalesce(F.col(f"{n}_ramp"), F.lit(False)))
    return both.select("from_id", "to_id", F.concat_ws(" ", label("from_id"), F.lit("->"), label("to_id"), F.concat(F.lit("("), F.col("weight"), F.lit(")"))).alias("line"))


def metric_table(scores: DataFrame, key: str | None = None) -> DataFrame:
    """Columns of scores as rows (metric, class, value), the class null for scores of the whole."""
    names = [n for n, t in scores.dtypes if n != key and t in ("double", "bigint", "int")]
    cls = F.col(key).cast("int") if key else F.lit(None).cast("int")
    each = F.array(*[F.struct(F.lit(n).alias("metric"), cls.alias("class"), F.col(n).cast("double").alias("value")) for n in names])
    return scores.select(F.explode(each).alias("x")).select("x.*")


def buffer_lines(buffers: DataFrame) -> DataFrame:
    """Rows of a buffer evaluation as text: bufferStep; completeness; correctness; accuracy [m]."""
    number = lambda c: F.format_string("%.4f", F.coalesce(c, F.lit(0.0)))
    return buffers.select("step", F.concat_ws("; ", F.col("step").cast("string"), *[number(F.col(c)) for c in ("completeness", "correctness", "accuracy")]).alias("line"))


def error_lines(error: DataFrame, rooms: DataFrame) -> DataFrame:
    """The share of cells in rooms without a partner, then those rooms (room_id, is_ramp), as numbered lines."""
    from cellgrove.operators.evaluation import room_label

    head = error.select(F.lit(-(1 << 31)).alias("at"), F.format_string("%d of %d cells (%.2f %%)", "errors", "total", F.col("error") * 100).alias("line"))
    return head.union(rooms.select(F.col("room_id").alias("at"), room_label(F.col("room_id"), F.col("is_ramp")).alias("line")))


def weighted_mean(scores: DataFrame, volumes: DataFrame, value: str, classes: tuple[int, ...] = (0, 2, 3, 4)) -> DataFrame:
    """One row: the mean of a score over classes, weighted by the cells (cls, n) of each."""
    both = scores.join(volumes.select("cls", F.col("n").alias("_w")), "cls").where(F.col("cls").isin(*classes))
    return both.agg(F.try_divide(F.sum(F.col(value) * F.col("_w")), F.sum("_w")).alias(value))
