"""Tables of labelled segments: areas, contacts, merging and relabelling. Rooms have ids above 0, transition spaces below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrove.operators.components import merge_ids
from cellgrove.operators.neighbours import CELL, touching_pairs, with_neighbours


def floor_areas(spaces: DataFrame, floors: DataFrame) -> DataFrame:
    """Cells of each segment that stand right on a floor: space_id, area."""
    on = floors.select((F.col("i") - 1).alias("i"), "r", "c").distinct().withColumn("_f", F.lit(1))
    return spaces.join(on, CELL, "left").groupBy("space_id").agg(F.coalesce(F.sum("_f"), F.lit(0)).alias("area"))


def footprint(cells: DataFrame, label: str) -> DataFrame:
    """Cells of each segment without a cell of it right below: label, area."""
    below = cells.select((F.col("i") - 1).alias("i"), "r", "c", label)
    return cells.select(*CELL, label).join(below, [*CELL, label], "left_anti").groupBy(label).agg(F.count("*").alias("area"))


def adjacency(spaces: DataFrame) -> DataFrame:
    """Pairs a < b of segments that touch within a slice, with the number of contacts."""
    return touching_pairs(spaces, "space_id", 4)


def contact_cells(spaces: DataFrame) -> DataFrame:
    """For each transition space and room: its cells that touch the room within a slice."""
    t, rooms = spaces.where("space_id < 0"), spaces.where("space_id > 0")
    both = with_neighbours(t, rooms, 4).select(*CELL, "space_id", F.col("n_space_id").alias("room_id")).distinct()
    return both.groupBy("space_id", "room_id").agg(F.count("*").alias("cells"), F.countDistinct("r", "c").alias("width"))


def adjacent_rooms(spaces: DataFrame) -> DataFrame:
    """For each transition space the sorted rooms that it touches; empty for none."""
    near = contact_cells(spaces).groupBy("space_id").agg(F.array_sort(F.collect_set("room_id")).alias("rooms"))
    return spaces.where("space_id < 0").select("space_id").distinct().join(near, "space_id", "left").withColumn("rooms", F.coalesce("rooms", F.array().cast("array<int>")))


def relabelled(spaces: DataFrame, mapping: DataFrame, label: str = "space_id") -> DataFrame:
    """Segments with the ids that a mapping (source, target) gives for them; others stay."""
    to = mapping.select(F.col("source").alias(label), "target")
    return spaces.join(to, label, "left").withColumn(label, F.coalesce("target", label)).drop("target")


def cluster_mapping(pairs: DataFrame) -> DataFrame:
    """Ids that pairs (a, b) link, mapped to the least of their cluster: source, target."""
    return merge_ids(pairs.select("a", "b")).select(F.col("v").alias("source"), F.col("label").alias("target"))


def dominant_room(spaces: DataFrame) -> DataFrame:
    """For each transition space the room it touches with most cells, the least id of equals."""
    best = F.min(F.struct(-F.col("cells"), "room_id"))
    return contact_cells(spaces).groupBy("space_id").agg(best["room_id"].alias("room_id"))


def without_dead_ends(spaces: DataFrame) -> DataFrame:
    """Transition spaces that touch one room become that room; those that touch none go."""
    near = adjacent_rooms(spaces)
    one = near.where("size(rooms) = 1").select(F.col("space_id").alias("source"), F.get("rooms", F.lit(0)).alias("target"))
    none = near.where("size(rooms) = 0").select("space_id")
    return relabelled(spaces.join(none, "space_id", "left_anti"), one)


def same_neighbours(spaces: DataFrame) -> DataFrame:
    """Touching transition spaces between the same rooms, mapped to the least id of their cluster."""
    t = spaces.where("space_id < 0")
    key = adjacent_rooms(spaces)
    pairs = touching_pairs(t, "space_id", 4).select("a", "b")
    both = pairs.join(key.select(F.col("space_id").alias("a"), F.col("rooms").alias("ra")), "a").join(key.select(F.col("space_id").alias("b"), F.col("rooms").alias("rb")), "b")
    return cluster_mapping(both.where("ra = rb").select("a", "b"))


def largest_parts(labelled: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Of each key's components the largest; equally large ones all stay."""
    n = labelled.groupBy(key, label).agg(F.count("*").alias("_n"))
    top = n.withColumn("_m", F.max("_n").over(Window.partitionBy(key))).where("_n = _m").select(key, label)
    return labelled.join(top, [key, label], "left_semi")


def large_enough(labelled: DataFrame, least: int, label: str = "label") -> DataFrame:
    """Components whose footprint of distinct (r, c) has at least so many cells."""
    n = labelled.select("r", "c", label).distinct().groupBy(label).agg(F.count("*").alias("_n"))
    return labelled.join(n.where(F.col("_n") >= least).select(label), label, "left_semi")


def small_room_mapping(spaces: DataFrame, areas: DataFrame, least: int) -> DataFrame:
    """Rooms of less area than `least` and the segments they touch, mapped to the least id of their cluster."""
    small = areas.where((F.col("space_id") > 0) & (F.col("area") < least)).select("space_id")
    pairs = adjacency(spaces)
    a = pairs.join(small.withColumnRenamed("space_id", "a"), "a", "left_semi")
    b = pairs.join(small.withColumnRenamed("space_id", "b"), "b", "left_semi")
    return cluster_mapping(a.union(b).select("a", "b").distinct())


def border_votes(labelled: DataFrame, normals: DataFrame, label: str = "label") -> DataFrame:
    """Contacts of each segment, over six neighbours outside it, with cells whose normal is up, down or horizontal."""
    at = labelled.select(*CELL, label)
    other = normals.select(*CELL, "normal").join(at.withColumnRenamed(label, "own").hint("merge"), CELL, "left")
    near = with_neighbours(at, other, 6).where(F.col("n_own").isNull() | (F.col("n_own") != F.col(label)))
    n = lambda *k: F.sum(F.col("n_normal").isin(*k).cast("int"))
    return near.groupBy(label).agg(n(2, 4).alias("up"), n(1, 4).alias("down"), n(3).alias("horizontal"))


def argmax(df: DataFrame, keys: list[str], value: Column, ties: list[str] | None = None) -> DataFrame:
    """Rows of the largest value in each group: all of them, or the first by `ties`."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    if ties:
        return df.withColumn("_k", F.row_number().over(w.orderBy(value.desc(), *ties))).where("_k = 1").drop("_k")
    return df.withColumn("_v", value).withColumn("_m", F.max("_v").over(w)).where("_v = _m").drop("_v", "_m")


def median(value: Column) -> Column:
    """The middle value, of an even number the mean of both, halves to the even number; 0 of none."""
    return F.coalesce(F.bround(F.median(value), 0), F.lit(0.0)).cast("int")
