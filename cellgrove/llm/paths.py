"""Windows of a corpus that occur more than once, as compacted paths of a de Bruijn graph.

Nodes are sequences of width - 1 items, edges the windows of `width` items that
lead from one node to the next. An edge for every item would move many times the
text, so edges first travel in runs: the consecutive edges of one document that
share an anchor, the least k-mer of the window. Anchor and run depend on the
content alone, so equal edges meet under their anchor. Runs with a copy are
repeated edges as they are; where an anchor has different runs the graph
branches, and their edges are taken one by one. What repeats is then linked
through the nodes between (see `compacted`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.arrow import by_slices
from cellgrove.llm.shared import Store
from cellgrove.llm.words import U64, gram_hashes, mix, range_hashes, sliding_argmin, window_starts

_RUN = "mh long, ph long, rid long, start long, n int"
_EDGE = "e long, proof int, rid long, start long, n int, own boolean"


def _emit(hashed, width: int, k: int):
    def f(rows, buf, offsets):
        values, first = hashed(buf, offsets)
        starts = window_starts(first, width)
        if not len(starts):
            return None
        grams = gram_hashes(values, k)
        anchor = sliding_argmin(grams, width - k + 1)[starts]
        new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        n = np.diff(np.r_[new, len(starts)])
        at = starts[new]
        ph = range_hashes(values, at, at + n + width - 1)
        row = np.searchsorted(first, at, "right") - 1
        rid = rows.column(0).to_numpy()[row]
        out = [pa.array(grams[anchor[new]].view(np.int64)), pa.array(ph.view(np.int64)), pa.array(rid), pa.array(at - first[row]), pa.array(n.astype(np.int32))]
        return pa.RecordBatch.from_arrays(out, ["mh", "ph", "rid", "start", "n"])

    return by_slices(f)


def _edges(hashed, width: int):
    """Repeated runs and the single edges of branching ones, read from the texts at their coordinates.

    `proof` is a second hash of the same items, of other hashes of them.
    """

    def f(rows, buf, offsets):
        values, first = hashed(buf, offsets)
        until, start, n, whole, split, own = places(rows.column(2))
        row = np.repeat(np.arange(rows.num_rows), np.diff(until))
        base = first[row] + start
        runs, parts = np.flatnonzero(whole), np.flatnonzero(split)
        m = n[parts]
        each = np.repeat(np.arange(len(parts)), m)
        inside = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        of = np.r_[runs, parts[each]]
        at = np.r_[base[runs], base[parts][each] + inside]
        length = np.r_[n[runs], np.ones(len(each), dtype=np.int32)]
        stop = at + length + width - 1
        e = range_hashes(values, at, stop)
        proof = range_hashes(mix(values ^ U64(0x94D049BB133111EB)), at, stop).view(np.int64).astype(np.int32)
        mine = np.r_[np.ones(len(runs), dtype=bool), own[parts][each]]
        out = [pa.array(e.view(np.int64)), pa.array(proof), pa.array(rows.column(0).to_numpy()[row[of]]), pa.array(at - first[row[of]]), pa.array(length.astype(np.int32)), pa.array(mine)]
        return pa.RecordBatch.from_arrays(out, ["e", "proof", "rid", "start", "n", "own"])

    return by_slices(f, most=1 << 20)


def repeated(texts: DataFrame, hashed, width: int, k: int, store: Store) -> DataFrame:
    """Edges and runs of edges of rows (rid, text) that occur twice or more: g (one for equal items), rid, start, n.

    hashed(bytes, offsets) gives the items' hashes and the number of items
    before each row. Runs whose anchor occurs once go; of the others, the texts
    are read again at their coordinates, and only what two places prove by both
    hashes stays. Counting goes through partial sums, the way back through
    joins whose other side has one row for a key: a passage that a third of all
    rows share is never in one task. Repeated rows are one source, once counted.
    """
    every = store.put(texts.select("rid", "text"), mapped=(_emit(hashed, width, k), _RUN))
    again = every.groupBy("mh").agg(F.count("*").alias("c"), F.min("ph").alias("lo"), F.max("ph").alias("hi")).where("c > 1")
    again = store.put(again.select("mh", (F.col("lo") == F.col("hi")).alias("one")), small=True)
    found = store.put(every.join(again, "mh").select("ph", "rid", "start", "n", "one"), small=True)
    store.drop(every)
    mixed = found.where("not one").drop("one")
    copies = store.put(mixed.groupBy("ph").agg(F.count("*").alias("copies"), F.min("rid").alias("first")), small=True)
    run = lambda whole, split, own: F.struct("start", "n", whole.alias("whole"), split.alias("split"), own.alias("own"))
    lone = F.col("copies") == 1
    at = found.where("one").select("rid", run(F.lit(True), F.lit(False), F.lit(False)).alias("x"))
    at = at.union(mixed.join(copies, "ph").select("rid", run(~lone, lone | (F.col("rid") == F.col("first")), lone).alias("x")))
    at = at.groupBy("rid").agg(F.collect_set("x").alias("at"))
    edges = store.put(texts.select("rid", "text").join(at.hint("merge"), "rid"), mapped=(_edges(hashed, width), _EDGE))
    store.drop(again, found, copies)
    proved = store.put(edges.groupBy("e", "proof").agg(F.count("*").alias("c")).where("c > 1").select("e", "proof"), small=True)
    kept = edges.where("own").join(proved, ["e", "proof"]).select(F.xxhash64("e", "proof").alias("g"), "rid", "start", "n")
    kept = store.put(kept.groupBy("rid", "start").agg(F.max("n").alias("n"), F.max("g").alias("g")), small=True)
    store.drop(edges, proved)
    return kept


def _ranked(links: DataFrame, store: Store) -> DataFrame:
    """Rows (v, root, off) of links (v, to, d), which give a v the one before it and its length d.

    Pointers double their reach each round. A vertex of a ring has no first one
    before it: when a round ends no vertex's way, only rings are left, and each
    vertex of them is its own root.
    """
    at, left, before = store.put(links.selectExpr("v", "to", "CAST(d AS LONG) AS d", "FALSE AS over"), small=True), -1, None
    while left not in (0, before):
        last = at
        for _ in range(2):
            on = at.selectExpr("v AS to", "to AS further", "d AS more", "over AS ends")
            step = at.where("not over").join(on, "to", "left")
            step = step.selectExpr("v", "coalesce(further, to) AS to", "d + coalesce(more, 0) AS d", "coalesce(ends, TRUE) AS over")
            at = step.union(at.where("over").select("v", "to", "d", "over"))
        at = store.put(at, small=True)
        store.drop(last)
        before, left = left, at.where("not over").count()
    return at.selectExpr("v", "IF(over, to, v) AS root", "IF(over, d, 0) AS off")


def compacted(edges: DataFrame, store: Store) -> DataFrame:
    """Repeated passages of documents: u (one for equal paths), rid, start, n windows.

    edges: rows (g, rid, start, n) as `repeated` gives them. Two that follow
    each other in any document meet in a node. Where only one leads in and only
    one out, the node doesn't branch and both become one path, by joins of edge
    to node and then by pointers to the path's first edge. A document may hold
    a part of a path, so spans are put together from its own coordinates.
    """
    tail = edges.selectExpr("rid", "start + n AS at", "g AS a", "n AS d")
    pairs = store.put(tail.join(edges.selectExpr("rid", "start AS at", "g AS b"), ["rid", "at"]).groupBy("a", "b").agg(F.max("d").alias("d")), small=True)
    alone = lambda c: pairs.groupBy(c).agg(F.count("*").alias("c")).where("c = 1").select(c)
    links = pairs.join(alone("a"), "a").join(alone("b"), "b").where("a <> b").selectExpr("b AS v", "a AS to", "d")
    ranks = _ranked(links, store)
    named = edges.join(ranks, F.col("g") == F.col("v"), "left").selectExpr("coalesce(root, g) AS u", "rid", "start", "n", "start - coalesce(off, 0) AS base")
    named = store.put(named, small=True)
    store.drop(pairs)
    spans = store.put(named.groupBy("rid", "u", "base").agg(F.min("start").alias("start"), (F.max(F.expr("start + n")) - F.min("start")).alias("n"), F.sum("n").alias("held")), small=True)
    gaps = spans.where("held < n").select("rid", "u", "base")
    return spans.where("held = n").select("u", "rid", "start", "n").union(named.join(gaps, ["rid", "u", "base"]).select("u", "rid", "start", "n"))


def places(column: pa.Array) -> tuple[np.ndarray, ...]:
    """The fields of a column of lists of structs, flat, after the number of entries before each row."""
    flat = column.flatten()
    lengths = np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    return (np.r_[0, np.cumsum(lengths)], *(x.to_numpy(zero_copy_only=False) for x in flat.flatten()))
