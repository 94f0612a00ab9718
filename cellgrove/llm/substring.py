"""Removal of long passages of words that occur more than once in a corpus."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.arrow import by_slices
from cellgrove.llm.paths import compacted, places, repeated
from cellgrove.llm.shared import Store, text_key
from cellgrove.llm.words import covered, span_hashes, word_spans

WIDTH, ANCHOR = 35, 8


def _hashed(buf, offsets):
    starts, ends, first = word_spans(buf, offsets)
    return span_hashes(buf, starts, ends), first


def repeated_passages(texts: DataFrame, store: Store, width: int = WIDTH, k: int = ANCHOR) -> DataFrame:
    """Compacted paths of the graph of `width`-word windows that start more than once: u, rid, start, n.

    texts: rows (rid, text). Windows start at the words start .. start + n - 1,
    so the passage has n + width - 1 words; passages of one u come from one
    path (see paths.py).
    """
    return compacted(repeated(texts, _hashed, width, k, store), store)


def _removed(texts: DataFrame, store: Store, width: int, k: int) -> DataFrame:
    """Per document with any, rid and at, an array of (start, n) of its repeated passages."""
    found = repeated_passages(texts, store, width, k)
    return store.put(found.groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("at")), small=True)


def _kept(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> bytes:
    """Kept words joined by one space."""
    s, e = starts[keep], ends[keep]
    if not len(s):
        return b""
    n = int(e[-1])
    word = np.zeros(n + 1, dtype=np.int8)
    word[s] += 1
    word[e] -= 1
    word = np.cumsum(word[:-1], dtype=np.int8) > 0
    after = np.zeros(n, dtype=bool)
    after[e[:-1]] = True
    out = np.where(word, buf[:n], np.uint8(0x20))
    return out[word | after].tobytes()


def _cut(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> bytes:
    """The text without the words that go and the white space behind each."""
    if keep.all():
        return buf.tobytes()
    nxt = np.r_[starts[1:], len(buf)]
    edge = np.zeros(len(buf) + 1, dtype=np.int64)
    np.add.at(edge, starts[~keep], 1)
    np.add.at(edge, nxt[~keep], -1)
    return buf[np.cumsum(edge[:-1]) == 0].tobytes()


def _report(width: int):
    def f(rows, buf, offsets):
        starts, ends, first = word_spans(buf, offsets)
        until, start, n = places(rows.column(3))
        removed, digest = [], []
        for i in range(rows.num_rows):
            w, m = slice(first[i], first[i + 1]), slice(until[i], until[i + 1])
            gone = covered(start[m], n[m], width, int(first[i + 1] - first[i]))
            removed.append(int(gone.sum()))
            digest.append(hashlib.sha256(_kept(buf[offsets[i] : offsets[i + 1]], starts[w] - offsets[i], ends[w] - offsets[i], ~gone)).hexdigest())
        out = [rows.column(1), pa.array(np.diff(first)), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
        return pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return by_slices(f)


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH, k: int = ANCHOR, name: str = "substring") -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the words that stay, for every row.

    A word goes if a window of `width` words covers it whose sequence also
    starts anywhere else, the same document included. Null or empty text: no
    words. Repeated rows repeat each other's windows. A null id stays null.
    Other columns are ignored; an empty table gives an empty result.
    """
    store = Store(docs.sparkSession, name, direct=True)
    texts = docs.select(text_key(id_col, text_col).alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    at = _removed(texts, store, width, k)
    return texts.join(at.hint("merge"), "rid", "left").select("rid", "doc_id", "text", "at").mapInArrow(_report(width), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH, k: int = ANCHOR, name: str = "substring") -> DataFrame:
    """The same rows and columns, with those words and the white space behind them cut from the text.

    Rows without a repeated passage keep their text byte for byte; a null text
    stays null.
    """
    store = Store(docs.sparkSession, name, direct=True)
    texts = docs.select(text_key(id_col, text_col).alias("rid"), F.col(text_col).alias("text"))
    at = _removed(texts, store, width, k)
    # fields by number: names of other columns may clash in any way
    fields = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    row = docs.select(text_key(id_col, text_col).alias("rid"), F.struct(*[f for f, c in zip(fields, docs.columns) if c != text_col], F.lit(0).alias("more")).alias("row"), F.col(text_col).alias("text"))

    def f(rows, buf, offsets):
        starts, ends, first = word_spans(buf, offsets)
        until, start, n = places(rows.column(2))
        out = []
        for i in range(rows.num_rows):
            w, m = slice(first[i], first[i + 1]), slice(until[i], until[i + 1])
            gone = covered(start[m], n[m], width, int(first[i + 1] - first[i]))
            out.append(_cut(buf[offsets[i] : offsets[i + 1]], starts[w] - offsets[i], ends[w] - offsets[i], ~gone).decode())
        texts = pa.array(out, pa.string())
        if rows.column(1).null_count:
            texts = pa.compute.if_else(rows.column(1).is_null(), pa.scalar(None, pa.string()), texts)
        return pa.RecordBatch.from_arrays([rows.column(0), texts], ["row", "text"])

    joined = row.join(at.hint("merge"), "rid", "left").select("row", "text", "at")
    done = joined.mapInArrow(by_slices(f), f"row {joined.schema['row'].dataType.simpleString()}, text string")
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
