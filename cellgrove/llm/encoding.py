"""Encoding of documents to token ids and back."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.arrow import by_slices, lists
from cellgrove.llm.bpe import LEAF, WordEncoder, encoded, pieces_of, word_encoder


def _shown(encoder: WordEncoder) -> tuple[list[bytes], list[bytes]]:
    """For every piece that the encoder keeps: its ids in decimal and its tokens, each with a space behind it."""
    if getattr(encoder, "shown_of", None) is not encoder.ids:
        encoder.shown_of, encoder.decimal, encoder.text = encoder.ids, [], []
    for x in encoder.ids[len(encoder.decimal) :]:
        ids = np.frombuffer(x, dtype="<u4").tolist()
        encoder.decimal.append(b"".join([b"%d " % i for i in ids]))
        encoder.text.append("".join([encoder.token[i] + " " for i in ids]).encode())
    return encoder.decimal, encoder.text


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, leaf: int = LEAF) -> DataFrame:
    """doc_id and ids (array<int>) of every row; null or empty text has none."""

    def f(rows, buf, offsets):
        ids = encoded(word_encoder(path, leaf), buf, offsets)
        flat = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)
        return pa.RecordBatch.from_arrays([rows.column(0), lists(flat, np.r_[0, np.cumsum([len(x) // 4 for x in ids])], pa.int32())], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(by_slices(f), "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """doc_id and the text that the vocabulary gives back for ids; null ids give an empty text."""

    def f(batches):
        token = word_encoder(path).token
        for b in batches:
            texts = [" ".join([token[i] for i in ids or []]) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", F.col(ids_col)).mapInArrow(f, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the decimal ids and of the decoded text, for every row.

    Unsplit pieces of more than `leaf` symbols are encoded as a tree: leaves of
    all such pieces in one batch, then windows around each join that grow until
    both sides agree. Null or empty text: no tokens, digests of nothing.
    Repeated rows, null ids and other columns change nothing; an empty table
    gives an empty result.
    """

    def f(rows, buf, offsets):
        encoder = word_encoder(path, leaf)
        places, cut = pieces_of(encoder, buf, offsets)
        decimal, text = _shown(encoder)
        n, a, b = [], [], []
        for i, j in zip(cut[:-1], cut[1:]):
            own = places[i:j]
            ids = b"".join(map(decimal.__getitem__, own))
            n.append(ids.count(b" "))
            a.append(hashlib.sha256(memoryview(ids)[:-1]).hexdigest())
            b.append(hashlib.sha256(memoryview(b"".join(map(text.__getitem__, own)))[:-1]).hexdigest())
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(by_slices(f, most=4 << 20), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
