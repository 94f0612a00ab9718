"""Allow and block rules over urls, in a trie of host labels and path segments."""

from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.shared import Store, text_key

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Bytes of a pickled trie up to which it is sent to every executor; larger rule sets are joined.
MOST_BYTES = 64 << 20


def _checked(rules: list[tuple[str, str, bool]]) -> dict[tuple[str, str], bool]:
    """Rules by lowered host and path; a rule given twice blocks if either does."""
    out: dict[tuple[str, str], bool] = {}
    for host, path, allow in rules:
        if not path.startswith("/"):
            raise ValueError(f"a rule's path starts with a slash: {host}{path}")
        key = (host.translate(_LOWER), path)
        out[key] = bool(allow) and out.get(key, True)
    return out


class Trie:
    """Rules (host, path, allow). A rule fits its host and all subdomains if the path starts with the rule's; the longest wins.

    Host labels are followed from the last, then path segments; what follows a
    rule's last slash (its tail) may end within a segment, so each node knows
    the lengths of its tails. Of rules of one length the one with the longer
    host wins, of the same rule twice the one that blocks. Edges are flat
    tables, so a trie of any depth can be sent.
    """

    def __init__(self, rules: list[tuple[str, str, bool]]):
        self.next: dict[tuple[int, str], int] = {}
        self.paths: dict[int, int] = {}
        self.tails: dict[tuple[int, str], tuple[int, bool, str]] = {}
        self.lengths: dict[int, list[int]] = {}
        self.nodes = 1
        for (host, path), allow in _checked(rules).items():
            node = 0
            for label in reversed(host.split(".")):
                node = self._to(self.next, (node, label))
            node = self._to(self.paths, node)
            *whole, tail = path[1:].split("/")
            for segment in whole:
                node = self._to(self.next, (node, segment))
            self.tails[node, tail] = (len(host + path), allow, host + path)
            self.lengths.setdefault(node, []).append(len(tail))
        self.lengths = {n: sorted(set(x)) for n, x in self.lengths.items()}

    def _to(self, table: dict, key) -> int:
        if key not in table:
            table[key] = self.nodes
            self.nodes += 1
        return table[key]

    def judge(self, host: str, path: str) -> tuple[str, bool] | None:
        """The rule that fits and whether it allows; None without one."""
        best, node = None, 0
        if not path.startswith("/"):
            return None
        segments = path[1:].split("/")
        for label in reversed(host.split(".")):
            node = self.next.get((node, label))
            if node is None:
                break
            at = self.paths.get(node)
            for segment in segments:
                if at is None:
                    break
                for k in self.lengths.get(at, ()):
                    if k > len(segment):
                        break
                    found = self.tails.get((at, segment[:k]))
                    if found and (best is None or found[0] >= best[0]):
                        best = found
                at = self.next.get((at, segment))
        return (best[2], best[1]) if best else None


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path: from behind the first :// up to / ? # or the end, lowered; then up to ? # or the end."""
    before, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))
    return rest[:end].translate(_LOWER), path[:stop]


def _split(batches):
    for b in batches:
        split = [split_url(u) for u in b.column(b.num_columns - 1).to_pylist()]
        host, path = (pa.array([x[i] for x in split], pa.string()) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], host, path], ["page_id", "rid", "host", "path"])


def judge(pages: DataFrame, rules: list[tuple[str, str, bool]], id_col: str = "page_id", url_col: str = "url", *, otherwise: bool = True, most_bytes: int = MOST_BYTES, name: str = "urls") -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    Without a rule that fits, rule is null and the verdict is `otherwise`
    (allow). A null url, or one without ://, has an empty host and path. No
    shuffle while the trie, as it is sent, has at most `most_bytes`: it goes to
    every executor. Larger rule sets are joined (see `judge_joined`). Work is
    linear in the url. Repeated rows, null ids and other columns change
    nothing; an empty table gives an empty result.
    """
    trie = Trie(rules)
    if len(pickle.dumps(trie)) > most_bytes:
        spark = pages.sparkSession
        table = spark.createDataFrame([(h, p, a) for (h, p), a in _checked(rules).items()], "host string, path string, allow boolean")
        return judge_joined(pages, table, id_col, url_col, otherwise=otherwise, name=name)
    sent = pages.sparkSession.sparkContext.broadcast(trie)

    def f(batches):
        for b in batches:
            split = [split_url(u) for u in b.column(1).to_pylist()]
            found = [sent.value.judge(h, p) for h, p in split]
            verdict = ["allow" if (x[1] if x else otherwise) else "block" for x in found]
            out = [b.column(0), [h for h, _ in split], [p for _, p in split], [x and x[0] for x in found], verdict]
            yield pa.RecordBatch.from_arrays([out[0], *[pa.array(x, pa.string()) for x in out[1:]]], ["page_id", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    return rows.mapInArrow(f, "page_id long, host string, path string, rule string, verdict string")


def judge_joined(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", *, otherwise: bool = True, name: str = "urls") -> DataFrame:
    """The same for rules in a table (host, path, allow) of any size; paths start with a slash.

    The trie's nodes are rows: a node is a host and the path up to a rule's last
    slash, with the lengths of its tails. Distinct urls meet the nodes of their
    host's suffixes and path's directories, then the rules of these nodes by
    tail; the longest of a url wins. Two joins on unique keys, so neither a host
    with very many rules nor a url that very many rows share meets in one task.
    """
    store = Store(pages.sparkSession, name)
    rules = rules.where("host is not null and path like '/%'").select(F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("h"), "path", F.coalesce("allow", F.lit(False)).alias("allow"))
    rules = rules.groupBy("h", "path").agg(F.min("allow").alias("allow"))
    rules = rules.select("h", F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1))) AS dir"), F.expr("substring_index(path, '/', -1) AS tail"), "allow")
    rules = store.put(rules)
    nodes = store.put(rules.groupBy("h", "dir").agg(F.collect_set(F.length("tail")).alias("lengths")))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), text_key(url_col).alias("rid"), F.col(url_col).alias("url"))
    rows = store.put(rows.mapInArrow(_split, "page_id long, rid long, host string, path string"))
    urls = rows.where("path like '/%'").dropDuplicates(["rid"]).select("rid", "host", "path")
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    each = urls.withColumn("l", labels).withColumn("p", parts).select("rid", "p", F.explode(F.expr("transform(sequence(1, size(l)), i -> array_join(slice(l, i, size(l)), '.'))")).alias("h"))
    each = each.select("rid", "h", F.explode(F.expr("transform(sequence(1, size(p) - 1), i -> struct(concat(array_join(slice(p, 1, i), '/'), '/') AS dir, p[i] AS segment))")).alias("x")).select("rid", "h", "x.*")
    tried = each.join(nodes, ["h", "dir"]).select("rid", "h", "dir", F.explode(F.expr("transform(filter(lengths, k -> k <= length(segment)), k -> substring(segment, 1, k))")).alias("tail"))
    fit = tried.join(rules, ["h", "dir", "tail"]).select("rid", F.struct((F.length("h") + F.length("dir") + F.length("tail")).alias("n"), F.length("h").alias("hn"), F.concat("h", "dir", "tail").alias("rule"), "allow").alias("x"))
    best = store.put(fit.groupBy("rid").agg(F.max("x").alias("x")).select("rid", "x.rule", "x.allow"))
    verdict = F.when(F.coalesce("allow", F.lit(otherwise)), "allow").otherwise("block")
    return rows.join(best, "rid", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
