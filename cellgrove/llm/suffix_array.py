"""Removal of long byte strings that occur earlier in a corpus, by difference-cover suffix arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.arrow import by_slices
from cellgrove.llm.paths import places
from cellgrove.llm.shared import Store, text_key
from cellgrove.llm.words import U64, covered, gram_hashes, mix, range_hashes, sliding_argmin, window_starts

WIDTH, ANCHOR = 100, 32
#: Bytes of text in one suffix array, and of one anchor's texts up to which they go into it whole.
BUCKET = 1 << 20
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_PATHS = "mh long, ph long, rid long, ord long, start long, n int"


def _packed(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """Integers in the order of the triples of values from 0 to 2**31 - 1; pairs are named where three values exceed 63 bits."""
    two, three = (int(x.max(initial=0)).bit_length() for x in (second, third))
    if int(first.max(initial=0)).bit_length() + two + three > 63:
        first, two, second = np.unique((first << two) | second, return_inverse=True)[1], 0, 0
    return (first << (two + three)) | (second << three) | third


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes of a sequence of integers from 0 to 2**31 - 2 in order, by the difference cover {1, 2} modulo 3.

    Suffixes that start at 1 or 2 modulo 3 are sorted by their first three
    values; equal triples share a name, and if any do, the sequence of names is
    sorted by the same algorithm. The others follow from one value and the rank
    behind it, and a merge puts both together.
    """
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), dtype=np.int64)
    t = np.zeros(n + 3, dtype=np.int64)
    t[:n] = text
    t[:n] += 1
    # a place behind the end keeps the two halves of the names apart
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    keys = _packed(t[sample], t[sample + 1], t[sample + 2])
    order = np.argsort(keys, kind="stable")
    new = np.r_[True, keys[order][1:] != keys[order][:-1]]
    names = np.empty(len(sample), dtype=np.int64)
    names[order] = np.cumsum(new)
    if not new.all():
        order = suffix_array(names)
        names[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[sample] = names
    sample = sample[order]
    sample = sample[sample < n]
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort((t[zero] << 32) | rank[zero + 1], kind="stable")]
    is_one = sample % 3 == 1
    ones, twos = sample[is_one], sample[~is_one]
    by_one = np.searchsorted((t[ones] << 32) | rank[ones + 1], (t[zero] << 32) | rank[zero + 1])
    both = np.r_[twos, zero]
    keys = _packed(t[both], t[both + 1], rank[both + 2])
    by_two = np.searchsorted(keys[: len(twos)], keys[len(twos) :])
    out = np.empty(n, dtype=np.int64)
    at = np.arange(len(zero)) + by_one + by_two
    out[at] = zero
    rest = np.ones(n, dtype=bool)
    rest[at] = False
    out[rest] = sample
    return out


def _emit(width: int, k: int):
    def f(rows, buf, offsets):
        values = _BYTE[buf]
        starts = window_starts(offsets, width)
        if not len(starts):
            return None
        grams = gram_hashes(values, k)
        anchor = sliding_argmin(grams, width - k + 1)[starts]
        new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        n = np.diff(np.r_[new, len(starts)])
        at = starts[new]
        ph = range_hashes(values, at, at + n + width - 1)
        row = np.searchsorted(offsets, at, "right") - 1
        out = [pa.array(grams[anchor[new]].view(np.int64)), pa.array(ph.view(np.int64)), pa.array(rows.column(0).to_numpy()[row]), pa.array(rows.column(1).to_numpy()[row]), pa.array(at - offsets[row]), pa.array(n.astype(np.int32))]
        return pa.RecordBatch.from_arrays(out, ["mh", "ph", "rid", "ord", "start", "n"])

    return by_slices(f)


def _cut_out(width: int):
    """The bytes of paths, from the documents they stand in."""

    def f(rows, buf, offsets):
        until, mh, start, n = places(rows.column(3))
        row = np.repeat(np.arange(rows.num_rows), np.diff(until))
        a = offsets[row] + start
        whole = buf.tobytes()
        text = [whole[i:j] for i, j in zip(a.tolist(), (a + n + width - 1).tolist())]
        take = pa.array(row)
        out = [pa.array(mh), rows.column(0).take(take), rows.column(1).take(take), pa.array(start), pa.array(n.astype(np.int32)), pa.array(text, pa.binary())]
        return pa.RecordBatch.from_arrays(out, ["mh", "rid", "ord", "start", "n", "text"])

    return by_slices(f)


def _later(width: int):
    """Of the windows of some paths, those that equal an earlier one: sorted suffixes, adjacent prefixes compared."""

    def f(table: pa.Table) -> pa.Table:
        table = table.sort_by([("ord", "ascending"), ("rid", "ascending"), ("start", "ascending")])
        texts = table["text"].to_pylist()
        n = table["n"].to_numpy().astype(np.int64)
        lengths = np.array([len(x) + 1 for x in texts])
        base = np.r_[0, np.cumsum(lengths)]
        raw = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
        text = raw.astype(np.int64) + 1
        text[base[1:] - 1] = 0
        order = suffix_array(text)
        path = np.searchsorted(base, order, "right") - 1
        valid = order - base[path] < n[path]
        order, path = order[valid], path[valid]
        same = np.zeros(len(order), dtype=bool)
        for a in range(1, len(order), 1 << 15):
            b = min(len(order), a + (1 << 15))
            left, right = order[a - 1 : b - 1], order[a:b]
            equal = np.ones(b - a, dtype=bool)
            for d in range(0, width, 20):
                rows = np.flatnonzero(equal)
                if not len(rows):
                    break
                shift = np.arange(d, min(d + 20, width))
                equal[rows] = (raw[left[rows, None] + shift] == raw[right[rows, None] + shift]).all(axis=1)
            same[a:b] = equal
        group = np.cumsum(~same)
        # texts stand in the order of their documents, so the least place of a group is its earliest window
        least = np.full(group[-1] + 1 if len(group) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, group, order)
        gone = order != least[group]
        path, at = path[gone], order[gone] - base[path[gone]]
        return pa.table({"rid": pa.array(table["rid"].to_numpy()[path]), "start": pa.array(table["start"].to_numpy()[path] + at)})

    return f


def _windows(width: int):
    """Every window of some paths with its hash."""

    def f(batches):
        for b in batches:
            for rid, order, start, n, text in zip(*(b.column(i).to_pylist() for i in range(5))):
                h = range_hashes(_BYTE[np.frombuffer(text, dtype=np.uint8)], np.arange(n), np.arange(n) + width)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([rid] * n, pa.int64()), pa.array([order] * n, pa.int64()), pa.array(start + np.arange(n))], ["h", "rid", "ord", "start"])

    return f


def later_windows(texts: DataFrame, store: Store, width: int = WIDTH, k: int = ANCHOR, bucket: int = BUCKET) -> DataFrame:
    """Per document (rid, ord, text) with any, the windows of `width` bytes that equal an earlier one.

    Returns rid and at, an array of (start, n). Documents are ordered by ord,
    then rid. Equal windows hold the same anchor, their least k-gram, so
    windows are first dealt by anchor. A run of windows with one anchor (a
    path) that occurs again as a whole goes, but for its first copy. Where an
    anchor has different paths, the first copies of each go to a suffix array
    of about `bucket` bytes with those of other anchors. The texts of one
    anchor that are longer than that together have their windows compared by
    hash with partial minima instead, so no task gets an unbounded group.
    """
    every = store.put(texts.select("rid", "ord", "text").mapInArrow(_emit(width, k), _PATHS))
    again = every.groupBy("mh").agg(F.count("*").alias("c"), F.min("ph").alias("lo"), F.max("ph").alias("hi")).where("c > 1")
    again = store.put(again.select("mh", (F.col("lo") == F.col("hi")).alias("one")), small=True)
    found = store.put(every.join(again, "mh"))
    store.drop(every, again)
    first = store.put(found.groupBy("ph").agg(F.min(F.struct("ord", "rid", "start")).alias("f")).select("ph", F.col("f.rid").alias("frid"), F.col("f.start").alias("fstart")), small=True)
    marked = store.put(found.join(first, "ph").withColumn("is_first", F.expr("rid = frid AND start = fstart")).select("mh", "rid", "ord", "start", "n", "one", "is_first"))
    store.drop(found, first)
    copies = marked.where("not is_first").select("rid", "start", "n")

    mixed = marked.where("is_first and not one").dropDuplicates(["rid", "start"])
    at = mixed.groupBy("rid").agg(F.collect_list(F.struct("mh", "start", "n")).alias("at"))
    cut = texts.select("rid", "ord", "text").join(at, "rid").dropDuplicates(["rid"]).mapInArrow(_cut_out(width), "mh long, rid long, ord long, start long, n int, text binary")
    cut = store.put(cut)
    size = cut.groupBy("mh").agg(F.sum(F.length("text")).alias("bytes"))
    large = store.put(size.where(F.col("bytes") > bucket).select("mh"), small=True)
    total = cut.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, -(-total // bucket))
    small = cut.join(large, "mh", "left_anti").withColumn("b", F.pmod(F.xxhash64("mh"), F.lit(buckets)))
    ends = store.put(small.groupBy("b").applyInArrow(_later(width), "rid long, start long")).select("rid", "start", F.lit(1).alias("n"))
    wide = cut.join(large, "mh").select("rid", "ord", "start", "n", "text").mapInArrow(_windows(width), "h long, rid long, ord long, start long")
    wide = store.put(wide)
    least = store.put(wide.groupBy("h").agg(F.min(F.struct("ord", "rid", "start")).alias("f")), small=True)
    wide = wide.join(least, "h").where("NOT (rid = f.rid AND start = f.start)").select("rid", "start", F.lit(1).alias("n"))
    gone = copies.union(ends).union(wide)
    return store.put(gone.groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("at")), small=True)


def _report(width: int):
    def f(rows, buf, offsets):
        until, start, n = places(rows.column(3))
        removed, spans, digest = [], [], []
        for i in range(rows.num_rows):
            own, m = buf[offsets[i] : offsets[i + 1]], slice(until[i], until[i + 1])
            gone = covered(start[m], n[m], width, len(own))
            removed.append(int(gone.sum()))
            spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            digest.append(hashlib.sha256(own[~gone].tobytes()).hexdigest())
        out = [rows.column(1), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())]
        return pa.RecordBatch.from_arrays(out, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return by_slices(f)


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH, k: int = ANCHOR, bucket: int = BUCKET, name: str = "suffix") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay, for every row.

    A byte goes if a string of `width` bytes covers it that also starts
    earlier: in a document of a smaller id, or before it in the same one. Rows
    with a null id come last; rows that share an id but not a text are ordered
    by a hash. Repeated rows are one document, each with the same result. Null
    or empty text: no bytes. Other columns are ignored; an empty table gives an
    empty result.
    """
    store = Store(docs.sparkSession, name)
    ident = F.col(id_col).cast("long")
    texts = docs.select(text_key(id_col, text_col).alias("rid"), ident.alias("doc_id"), F.coalesce(ident, F.lit((1 << 63) - 1)).alias("ord"), F.col(text_col).alias("text"))
    at = later_windows(texts, store, width, k, bucket)
    return texts.join(at, "rid", "left").select("rid", "doc_id", "text", "at").mapInArrow(_report(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
