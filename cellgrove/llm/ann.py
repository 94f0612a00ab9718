"""Nearest neighbours by inner product: multi-index hashing over learned binary codes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellgrove.llm.shared import Store

#: Distinct vectors, chosen by hash, that codes and radius are fitted on: a bound of the driver's work. All vectors are indexed.
SAMPLE = 20_000
KEYS, QUERIES = 32_768, 2_048
PART = 16
_ONES = np.array([bin(i).count("1") for i in range(1 << PART)], dtype=np.uint8)


@dataclass
class Codes:
    """Rotations after which the signs of centred vectors are a binary code, and a search radius."""

    mean: np.ndarray
    most: float
    rotation: np.ndarray
    radius: int

    def of_keys(self, x: np.ndarray) -> np.ndarray:
        """Codes as 16-bit parts. A last coordinate makes all keys equally long, so that angle and inner product order alike."""
        x = x - self.mean
        rest = np.sqrt(np.maximum(0, self.most**2 - (x * x).sum(axis=1)))
        return self._parts(np.c_[x, rest])

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return self._parts(np.c_[q, np.zeros(len(q))])

    def _parts(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.rotation > 0, axis=1).view(np.uint16)


def _itq(x: np.ndarray, seed: int, rounds: int = 20) -> np.ndarray:
    """A rotation that brings x near the corners of a cube."""
    d = x.shape[1]
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(x.T @ np.sign(x @ r))
        r = u @ v
    return r


def fit(sample: np.ndarray, most_norm: float, *, bits: int = 128, k: int = 20, share: float = 0.985, seed: int = 5) -> Codes:
    """Codes of about `bits` bits and the radius within which `share` of the sample's true k neighbours lie.

    Neighbours in a sample are no nearer than those in the whole table, so the
    radius holds for the whole.
    """
    mean = sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])
    most = most_norm + float(np.linalg.norm(mean))
    x = np.c_[sample - mean, np.sqrt(np.maximum(0, most**2 - ((sample - mean) ** 2).sum(axis=1)))]
    d = x.shape[1]
    low = x - x.mean(axis=0)
    blocks = -(-max(bits, PART) // d)
    rotation = np.concatenate([_itq(low, seed + i) for i in range(blocks)], axis=1)
    rotation = rotation[:, : max(PART, rotation.shape[1] // PART * PART)]
    if rotation.shape[1] % PART:
        rotation = np.c_[rotation, np.random.default_rng(seed).normal(size=(d, -rotation.shape[1] % PART))]
    codes = Codes(mean, most, rotation, rotation.shape[1])
    asked = sample[:: max(1, len(sample) // 500)]
    if len(sample) > k + 1:
        keys, queries = codes.of_keys(sample), codes.of_queries(asked)
        true = np.argsort(-(asked @ sample.T), axis=1)[:, 1 : k + 1]
        far = _ONES[keys[true] ^ queries[:, None, :]].sum(axis=2)
        codes.radius = int(np.quantile(far, share))
    return codes


class MultiIndex:
    """Codes by each of their 16-bit parts. Within a radius r some part differs in at most r // parts bits."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.values, self.order, self.starts = [], [], []
        for part in codes.T:
            order = np.argsort(part, kind="stable")
            values, starts = np.unique(part[order], return_index=True)
            self.values.append(values)
            self.order.append(order)
            self.starts.append(np.r_[starts, len(part)])

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Places of all codes within the radius: probed part by part, then checked on the whole."""
        near = radius // len(code)
        seen = np.zeros(len(self.codes), dtype=bool)
        for values, order, starts, part in zip(self.values, self.order, self.starts, code):
            buckets = np.repeat(_ONES[values ^ part] <= near, np.diff(starts))
            seen[order[buckets]] = True
        at = np.flatnonzero(seen)
        return at[_ONES[self.codes[at] ^ code].sum(axis=1, dtype=np.int64) <= radius]


def _search(codes: Codes, k: int):
    def f(left: pa.Table, right: pa.Table) -> pa.Table:
        out_h, out_s, out_id = [], [], []
        if left.num_rows and right.num_rows:
            keys = np.array(left["x"].combine_chunks().flatten(), dtype=np.float64).reshape(left.num_rows, -1)
            queries = np.array(right["x"].combine_chunks().flatten(), dtype=np.float64).reshape(right.num_rows, -1)
            ids = left["ids"].to_pylist()
            index, coded = MultiIndex(codes.of_keys(keys)), codes.of_queries(queries)
            for h, q, code in zip(right["h"].to_pylist(), queries, coded):
                radius = codes.radius
                at = index.within(code, radius)
                while len(at) <= k and len(at) < len(keys) and radius < 16 * coded.shape[1]:
                    radius += max(4, radius // 4)
                    at = index.within(code, radius)
                score = keys[at] @ q
                if len(at) > 2 * k:
                    top = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                    at = at[score >= top - 1e-9 * max(1.0, abs(top))]
                score = (keys[at] * q).sum(axis=1)
                found = sorted((-s, i) for s, a in zip(score.tolist(), at.tolist()) for i in ids[a])[: k + 1]
                out_h += [h] * len(found)
                out_s += [-s for s, _ in found]
                out_id += [i for _, i in found]
        return pa.table({"h": pa.array(out_h, pa.int64()), "score": pa.array(out_s, pa.float64()), "vec_id": pa.array(out_id, pa.int64())})

    return f


def nearest(vectors: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 20, every: int = 20, bits: int = 128, name: str = "ann") -> DataFrame:
    """The k rows of largest inner product for each query: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by `every` unless given as a
    table of ids. All other rows are candidates; ties go to the smaller id.
    Equal vectors are indexed once, with their k + 1 least ids, which no result
    needs more of; so a vector that very many rows share is one key. Keys and
    queries meet in blocks of a fixed size, each pair of blocks in one task
    that indexes the keys' codes by 16-bit parts and probes them; codes within
    the radius are reranked by the inner product of the original vectors in
    double precision. A query with too few codes within the radius widens it
    until it has enough or all.

    Null vectors, vectors of only zeros, with null or non-finite components, or
    of another length than most take no part, nor do null ids. Repeated ids are
    rows of their own. Fewer than k candidates: all of them. An empty table
    gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    store = Store(spark, name)
    x = F.col("x")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.where(x.isNotNull() & F.col("vec_id").isNotNull() & ~bad & F.exists(x, lambda v: v != 0)).withColumn("h", F.xxhash64("x"))
    rows = rows.withColumn("x", x.cast("array<float>")) if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else rows
    wide = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not wide:
        return empty
    rows = store.put(rows.where(F.size("x") == wide[0]["d"]))
    few = Window.partitionBy("h", "salt").orderBy("vec_id")
    least = rows.withColumn("salt", F.pmod("vec_id", F.lit(64))).withColumn("rn", F.row_number().over(few)).where(F.col("rn") <= k + 1)
    least = least.withColumn("rn", F.row_number().over(Window.partitionBy("h").orderBy("vec_id"))).where(F.col("rn") <= k + 1)
    keys = store.put(least.groupBy("h").agg(F.first("x").alias("x"), F.collect_list("vec_id").alias("ids")))
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "h") if queries is None else rows.join(queries.select(F.col(id_col).alias("vec_id")).distinct(), "vec_id").select("vec_id", "h")
    asked = store.put(asked.withColumnRenamed("vec_id", "query_id"))
    each = store.put(keys.join(asked.select("h").distinct(), "h").select("h", "x"))

    sample = keys.select("x", F.xxhash64("h").alias("o")).orderBy("o").limit(SAMPLE).select("x").collect()
    norm = keys.agg(F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v))).first()[0]
    codes = fit(np.array([r["x"] for r in sample], dtype=np.float64), float(norm) ** 0.5, bits=bits, k=k)
    nk, nq = max(1, -(-keys.count() // KEYS)), max(1, -(-each.count() // QUERIES))
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = keys.withColumn("kb", F.pmod("h", F.lit(nk)).cast("int")).withColumn("qb", blocks(nq))
    right = each.withColumn("qb", F.pmod(F.xxhash64("h"), F.lit(nq)).cast("int")).withColumn("kb", blocks(nk))
    found = left.groupBy("kb", "qb").cogroup(right.groupBy("kb", "qb")).applyInArrow(_search(codes, k), "h long, score double, vec_id long")
    best = Window.partitionBy("h").orderBy(F.desc("score"), "vec_id")
    found = store.put(found.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k + 1).drop("rn"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = asked.join(found, "h").where("vec_id <> query_id").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


__all__ = ["Codes", "MultiIndex", "fit", "nearest"]
