"""Secrets in texts, told apart by how many repositories and owners hold them."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.shared import Store, text_key

# fixed values: the base patterns and the least length of each
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}

KINDS = ["assign", "access", "hex", "owned"]
_SPAN = "array<struct<start:int,kind:int,stop:int,secret:string>>"
#: A run of 20 or more characters of keys; it must hold upper and lower case letters and digits.
_OWNED = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
# runs of hex digits are maximal, so those that are too short can be left out by the pattern
_HEX = re.compile(HEX.replace("+", "{32,}"))


def spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, secret) of base spans and of candidates that only the corpus can judge."""
    out = [(m.start(), 0, m.end(), m.group(2)) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= LEAST["assign"]]
    out += [(m.start(), 1, m.end(), m.group()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end(), m.group()) for m in _HEX.finditer(text)]
    for m in _OWNED.finditer(text):
        s, a, b = m.group(), m.start(), m.end()
        if re.search("[a-z]", s) and re.search("[A-Z]", s) and re.search("[0-9]", s) and len(set(s)) >= 12 and not any(x[0] < b and a < x[2] for x in out if x[1] < 3):
            out.append((a, 3, b, s))
    return sorted(out)


def _scan(batches):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("secret", pa.string())]))
    names = ["start", "kind", "stop", "secret"]
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            found = [[dict(zip(names, s)) for s in spans(t or "")] for t in part.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(found, kind)], ["row", "doc_id", "rid", "repo", "owner", "found"])


def _joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["stop"])), ",")


def _part(docs: DataFrame, column: str | None) -> Column | None:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")) if column and column in docs.columns else None


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str | None = None, *, most_owners: int = 1, most_repos: int = 5, name: str = "secrets") -> DataFrame:
    """Per row: doc_id, rid, found (sorted spans of start, kind, stop and secret hash, with `live`).

    Base kinds are always found. A candidate of another form (kind owned) is
    found only if it looks live: its hash occurs with at most `most_owners`
    owners and in at most `most_repos` repositories of the whole corpus; widely
    copied ones are examples, and what one owner repeats in very many
    repositories is a template. `live` says the same of base spans. Without an
    owner column the owner is what stands before the first slash of the
    repository (owner/name), or the repository itself without a slash. The
    corpus is aggregated by distinct (hash, repository, owner) first, so a
    secret that very many rows hold costs one row for each task. A null
    repository or owner is one of its own kind. Null or empty text: nothing
    found. Repeated rows get the same spans; other columns are ignored; an
    empty table gives an empty result.
    """
    return _scanned(docs, id_col, text_col, repo_col, owner_col, most_owners, most_repos, name, [])


def _scanned(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str | None, most_owners: int, most_repos: int, name: str, row: list[Column]) -> DataFrame:
    """doc_id, rid and found of every row, with the columns `row`. Only rows with candidates that the corpus judges are joined."""
    store = Store(docs.sparkSession, name)
    repo = _part(docs, repo_col)
    repo = F.lit("") if repo is None else repo
    owner = _part(docs, owner_col)
    owner = F.substring_index(repo, "/", 1) if owner is None else owner
    rows = docs.select(F.struct(F.lit(0).alias("more"), *row).alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_key(id_col, text_col).alias("rid"), repo.alias("repo"), owner.alias("owner"), F.col(text_col).alias("text"))
    seen = rows.mapInArrow(_scan, f"row {rows.schema['row'].dataType.simpleString()}, doc_id long, rid long, repo string, owner string, found {_SPAN}")
    hashed = F.transform("found", lambda x: F.struct(x["start"], x["kind"], x["stop"], F.xxhash64(x["secret"]).alias("h")))
    seen = store.put(seen.withColumn("found", hashed))
    each = seen.where("size(found) > 0").select("rid", "repo", "owner", F.explode("found").alias("x"))
    held = each.select(F.col("x.h").alias("h"), "repo", "owner").distinct()
    # two steps, each with partial sums: repositories of an owner, then owners and repositories of a hash
    held = held.groupBy("h", "owner").agg(F.count("*").alias("repos")).groupBy("h").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    live = store.put(held.where((F.col("owners") <= most_owners) & (F.col("repos") <= most_repos)).select("h"), small=True)
    alive = store.put(each.select("rid", "x", F.col("x.h").alias("h")).join(live, "h").select("rid", "x").distinct(), small=True)
    alive = alive.groupBy("rid").agg(F.collect_set(F.col("x")).alias("alive"))
    kind = "array<struct<start:int,kind:int,stop:int,h:bigint>>"
    met = seen.where("size(found) > 0").join(alive, "rid", "left").select("row", "doc_id", "rid", "found", F.coalesce("alive", F.array().cast(kind)).alias("alive"))
    out = met.union(seen.where("size(found) = 0").select("row", "doc_id", "rid", "found", F.array().cast(kind)))
    marked = F.transform("found", lambda x: F.struct(x["start"], x["kind"], x["stop"], F.array_contains("alive", x).alias("live")))
    return out.select(*[F.col(f"row.{c}") for c in out.schema["row"].dataType.names[1:]], "doc_id", "rid", F.filter(marked, lambda x: (x["kind"] < 3) | x["live"]).alias("found"))


def report(found: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, spans, and live_spans."""
    base = F.filter("found", lambda x: x["kind"] < 3)
    n = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    live = F.filter("found", lambda x: x["live"])
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), _joined(live).alias("live_spans"))


def masked(text: str, spans: list[dict], mark: str) -> str:
    """The text with every run of overlapping spans (start, stop), in order, replaced by one mark."""
    out, at = [], 0
    for x in spans:
        if x["start"] >= at:
            out += [text[at : x["start"]], mark]
        at = max(at, x["stop"])
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", **how) -> DataFrame:
    """The same rows and columns with every span found replaced by a mark; other texts stay as they are.

    Overlapping spans are replaced together by one mark. Null texts stay null;
    repeated rows change alike; names of other columns may clash with any used
    here; an empty table gives an empty result. Work is linear in the text.
    """
    # fields by number: names of other columns may clash in any way
    row = F.struct(F.lit(0).alias("more"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col])
    how = {"repo_col": "source", "owner_col": None, "most_owners": 1, "most_repos": 5, "name": "secrets"} | how
    found = _scanned(docs, id_col, text_col, row=[F.struct(row.alias("row"), F.col(f"`{text_col}`").alias("text")).alias("whole")], **how)
    both = found.select("whole.row", "whole.text", F.transform("found", lambda x: F.struct(x["start"], x["stop"])).alias("at"))

    def f(batches):
        for b in batches:
            texts = [t if t is None or not at else masked(t, at, mark) for t, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["row", "text"])

    done = both.mapInArrow(f, f"row {both.schema['row'].dataType.simpleString()}, text string")
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
