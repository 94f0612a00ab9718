"""Connected components by hooking and contraction, with joins and partial aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.shared import Store


def components(edges: DataFrame, store: Store) -> DataFrame:
    """Rows (v, label) for every end of an edge (a, b): label is the least vertex that v reaches.

    Each round lets every vertex point to its least neighbour, follows the
    pointers to their roots and keeps the edges between different roots. A
    vertex with very many edges is only ever met by a minimum with partial
    sums, or by a join whose other side has one row for it, which adaptive
    execution splits. An empty edge table gives no rows; loops and repeated
    edges change nothing; null ends are ignored.
    """
    edges = edges.where("a is not null and b is not null")
    ends = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
    labels, left = None, store.put(ends.where("v <> w").distinct())
    while not left.isEmpty():
        parent = left.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("label"))
        parent = _to_roots(store.put(parent), store)
        labels = parent if labels is None else _moved(labels, parent, store)
        by_v = left.join(parent.withColumnRenamed("label", "rv"), "v").select("rv", "w")
        both = by_v.join(parent.select(F.col("v").alias("w"), F.col("label").alias("rw")), "w")
        nxt = store.put(both.where("rv <> rw").select(F.col("rv").alias("v"), F.col("rw").alias("w")).distinct())
        store.drop(left)
        left = nxt
    return left.select("v", F.col("w").alias("label")) if labels is None else labels


def _moved(labels: DataFrame, parent: DataFrame, store: Store) -> DataFrame:
    """labels with every label replaced by the one that parent gives for it."""
    to = parent.select(F.col("v").alias("label"), F.col("label").alias("root"))
    return store.put(labels.join(to, "label", "left").select("v", F.coalesce("root", "label").alias("label")))


def merged(labels: DataFrame | None, edges: DataFrame, store: Store) -> DataFrame:
    """The labels (v, label) after more edges (a, b); a vertex without a label is its own."""
    if labels is None:
        return components(edges, store)
    la = labels.select(F.col("v").alias("a"), F.col("label").alias("la"))
    lb = labels.select(F.col("v").alias("b"), F.col("label").alias("lb"))
    named = store.put(edges.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    moved = components(named, store)
    fresh = moved.join(labels.select("v"), "v", "left_anti")
    return store.put(_moved(labels, moved, store).union(fresh))


def _to_roots(parent: DataFrame, store: Store) -> DataFrame:
    """Follow pointers until every vertex points to a root; doubles the distance each time."""
    while True:
        up = parent.select(F.col("v").alias("label"), F.col("label").alias("root"))
        nxt = store.put(parent.join(up, "label").select("v", F.col("root").alias("label"), (F.col("root") != F.col("label")).alias("moved")))
        store.drop(parent)
        parent = nxt.select("v", "label")
        parent._stored_at = nxt._stored_at
        if nxt.where("moved").isEmpty():
            return parent
