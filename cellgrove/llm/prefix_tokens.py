"""Exact token counts of every prefix, by dynamic programming over a piece vocabulary."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.arrow import by_slices, lists
from cellgrove.llm.bpe import KEPT, Merger
from cellgrove.llm.words import U64, mix, span_hashes, word_spans

SPACE = "▁"
#: White space that stands in no piece of the vocabularies of this kind; other white space does.
_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[[0x20, 0x09, 0x0A]] = True
#: Characters of a unit above which it is taken in windows.
SHORT = 64


#: Characters of the windows in which longer units are taken side by side.
WINDOW = 512


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)


class PrefixCounter:
    """Token counts of all prefixes of a text under a sentencepiece BPE vocabulary with byte fallback.

    The last token of a prefix follows from shorter prefixes: a token may end
    there if its text is a piece and the encoding of the pair it forms with the
    last token before it is that pair. Exactly one does, so each prefix has its
    count from one shorter prefix. No piece has a space behind another
    character, so the program starts anew at every word, and words are kept.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        plain.sort(key=lambda i: -sp.get_score(i))
        pieces = [sp.id_to_piece(i) for i in plain]
        if any(SPACE in p.lstrip(SPACE) or set(p) & set(" \t\n") for p in pieces):
            raise ValueError("a piece reaches over white space")
        # characters that only stand in longer pieces are symbols too, but as tokens they are their bytes
        alone = sorted({c for p in pieces for c in p} - {p for p in pieces if len(p) == 1})
        symbols = pieces + alone
        rank = {p: r for r, p in enumerate(symbols)}
        pairs = np.array([(rank[p[:i]], rank[p[i:]], r) for r, p in enumerate(pieces) for i in range(1, len(p)) if p[:i] in rank and p[i:] in rank])
        score = np.unique([-sp.get_score(i) for i in plain], return_inverse=True)[1]
        self.unknown = len(symbols)
        self.text = [np.array([ord(c) for c in p]) for p in symbols]
        self.cost = np.array([1] * len(pieces) + [len(c.encode()) for c in alone])
        sizes = np.array([len(p) for p in symbols] + [1])
        self.merger = Merger(pairs[:, :2], score[pairs[:, 2]], pairs[:, 2], sizes)
        self.single = np.full(0x110000, self.unknown, dtype=np.int64)
        for p, r in rank.items():
            if len(p) == 1:
                self.single[ord(p)] = r
        self._trie(rank)
        self.valid = np.full(1 << 20, -1, dtype=np.int64)
        self.lengths = np.array([len(t) for t in self.text])
        self.begins = np.r_[0, np.cumsum(self.lengths)[:-1]]
        self.flat = self.single[np.concatenate(self.text)]
        self.clear()

    def _trie(self, rank: dict[str, int]) -> None:
        """Edges (node, character) to nodes, sorted; reachable pieces at their nodes."""
        symbols = [self.single[t] for t in self.text]
        whole = self.merger._batch(symbols)
        reachable = np.array([len(x) == 1 for x in whole])
        nodes = {"": 0}
        for p in rank:
            for i in range(1, len(p) + 1):
                nodes.setdefault(p[:i], len(nodes))
        edge = {(nodes[p[:-1]] << 21) | ord(p[-1]): n for p, n in nodes.items() if p}
        self.edge_keys = np.array(sorted(edge))
        self.edge_to = np.array([edge[k] for k in self.edge_keys.tolist()])
        self.piece_at = np.full(len(nodes), -1, dtype=np.int64)
        for p, r in rank.items():
            if reachable[r]:
                self.piece_at[nodes[p]] = r

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def _matches(self, chars: np.ndarray, until: np.ndarray):
        """For l = 1, 2, ...: the starts at which a known string of l characters begins, and the piece it is or -1."""
        at = np.arange(len(chars))
        node = np.zeros(len(chars), dtype=np.int64)
        step = 0
        while len(at):
            keys = (node << 21) | chars[at + step]
            i = np.minimum(np.searchsorted(self.edge_keys, keys), len(self.edge_keys) - 1)
            hit = self.edge_keys[i] == keys
            at, node = at[hit], self.edge_to[i[hit]]
            step += 1
            yield step, at, self.piece_at[node]
            more = at + step < until[at]
            at, node = at[more], node[more]

    def _valid(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the encoding of the text of two tokens is the two.

        Answers are kept in a table with one place for each hash, where a newer
        pair takes the place of an older one.
        """
        keys = (a << 21) | (b << 1)
        slot = (mix(keys.astype(U64)) & U64(len(self.valid) - 1)).astype(np.int64)
        got = self.valid[slot]
        missing = np.flatnonzero((got & ~1) != keys)
        if len(missing):
            new = pd.unique(keys[missing])
            left, right = new >> 21, (new >> 1) & 0xFFFFF
            n = np.stack([self.lengths[left], self.lengths[right]], axis=1).ravel()
            src = np.stack([self.begins[left], self.begins[right]], axis=1).ravel()
            offs = np.r_[0, np.cumsum(n)]
            symbols = self.flat[np.repeat(src - offs[:-1], n) + np.arange(offs[-1])]
            ids, cut = self.merger.merge(symbols, offs[::2])
            answer = (np.diff(cut) == 2) & (ids[cut[:-1]] == left)
            self.valid[(mix(new.astype(U64)) & U64(len(self.valid) - 1)).astype(np.int64)] = new | answer
            order = np.argsort(new)
            got[missing] = (new | answer)[order][np.searchsorted(new[order], keys[missing])]
        return (got & 1) == 1

    def counts(self, chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token counts of all prefixes of units of code points, and their last tokens; unit i is chars[offsets[i] : offsets[i + 1]]."""
        lengths = np.diff(offsets)
        until = np.repeat(offsets[1:], lengths)
        first = np.repeat(offsets[:-1], lengths)
        n = len(chars)
        # matches sorted by the place at which they end
        starts, ends, ids = [], [], []
        for step, at, piece in self._matches(chars, until):
            ok = piece >= 0
            starts.append(at[ok])
            ends.append(at[ok] + step - 1)
            ids.append(piece[ok])
        unknown = np.flatnonzero(self.single[chars] == self.unknown)
        starts, ends = np.concatenate([*starts, unknown]), np.concatenate([*ends, unknown])
        ids = np.concatenate([*ids, np.full(len(unknown), self.unknown)])
        step = ends - first[ends]
        order = np.argsort(step, kind="stable")
        starts, ends, ids, step = starts[order], ends[order], ids[order], step[order]
        cut = np.searchsorted(step, np.arange(int(lengths.max(initial=0)) + 1))
        bytes_ = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        last, count = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            s, e, p = starts[a:b], ends[a:b], ids[a:b]
            head = s == first[s]
            before = np.where(head, -1, last[s - 1])
            free = head | (p == self.unknown) | (before == self.unknown)
            ok = free.copy()
            test = np.flatnonzero(~free)
            if len(test):
                ok[test] = self._valid(before[test], p[test])
            s, e, p, head = s[ok], e[ok], p[ok], head[ok]
            last[e] = p
            count[e] = np.where(head, 0, count[s - 1]) + np.where(p == self.unknown, bytes_[s], self.cost[np.minimum(p, self.unknown - 1)])
        return count, last

    def _windows(self, texts: list[np.ndarray], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Last tokens and counts of all prefixes of windows of the texts, side by side."""
        offs = np.r_[0, np.cumsum([len(x) for x in texts])]
        count, last = self.counts(np.concatenate(texts), offs)
        return [(last[a:b], count[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]

    def long_counts(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Token counts of all prefixes of units of any length.

        A unit is cut into windows that overlap, and the program runs over all
        windows side by side, each as if a unit began there. What it finds at a
        place depends on the last tokens of as many places before it as the
        longest piece has characters. So where a window has agreed with the one
        before it for that long, in its last tokens and in the difference of
        counts, it agrees from there on. Where it doesn't within the overlap,
        prefixes follow one by one until it does.
        """
        reach = int(self.lengths.max())
        lap, size = 4 * reach, max(WINDOW, 8 * reach)
        cuts = [[(a, min(len(x), a + size + lap)) for a in range(0, max(1, len(x) - lap), size)] for x in texts]
        flat = [x[a:b] for x, c in zip(texts, cuts) for a, b in c]
        found = iter(self._windows(flat, size + lap)) if flat else iter(())
        out = []
        for x, own in zip(texts, cuts):
            count, last = np.zeros(len(x), dtype=np.int64), np.full(len(x), -1, dtype=np.int64)
            for k, (a, b) in enumerate(own):
                wl, wc = next(found)
                known = own[k - 1][1] if k else 0
                at = self._meets(last[a:known], count[a:known], wl, wc, reach) if k else 0
                if at is None:
                    known = self._onward(x, last, count, known, b, lambda e: self._meets(last[e - reach : e], count[e - reach : e], wl[e - reach - a :], wc[e - reach - a :], reach) is not None)  # noqa: B023
                    if known == b:
                        continue
                    at = known - 1 - a
                off = count[a + at] - wc[at] if k else 0
                last[a + at : b], count[a + at : b] = wl[at:], wc[at:] + off
            out.append(count)
        return out

    @staticmethod
    def _meets(last, count, window_last, window_count, reach: int) -> int | None:
        """The last place of the first stretch of `reach` places that agree in tokens and in the difference of counts."""
        n = len(last)
        off = count - window_count[:n]
        same = (last == window_last[:n]) & np.r_[True, off[1:] == off[:-1]]
        same[:1] = last[:1] == window_last[:1]
        run = np.r_[0, np.cumsum(same)]
        ends = np.flatnonzero(run[reach:] - run[: len(run) - reach] == reach) if n >= reach else []
        return int(ends[0]) + reach - 1 if len(ends) else None

    def _onward(self, chars: np.ndarray, last: np.ndarray, count: np.ndarray, a: int, b: int, over) -> int:
        """Fill places from a to b - 1 one by one from what stands before them, until over(place behind) holds; the place behind the last one filled."""
        lo = max(0, a - int(self.lengths.max()))
        ending: list[list[tuple[int, int]]] = [[] for _ in range(b - lo)]
        for step, at, piece in self._matches(chars[lo:b], np.full(b - lo, b - lo)):
            for s, p in zip(at[piece >= 0].tolist(), piece[piece >= 0].tolist()):
                ending[s + step - 1].append((s + lo, p))
        for e in range(a, b):
            if self.single[chars[e]] == self.unknown:
                last[e] = self.unknown
                count[e] = (count[e - 1] if e else 0) + len(chr(chars[e]).encode("utf-8", "replace"))
            else:
                for s, p in ending[e - lo]:
                    if s == 0 or last[s - 1] == self.unknown or self._pair(int(last[s - 1]), p):
                        last[e] = p
                        count[e] = (count[s - 1] if s else 0) + self.cost[p]
                        break
            if (e - a) % 64 == 63 and over(e + 1):
                return e + 1
        return b

    def _pair(self, a: int, b: int) -> bool:
        if len(self.pairs) > KEPT:
            self.pairs.clear()
        if (a, b) not in self.pairs:
            self.pairs[a, b] = bool(self._valid(np.array([a]), np.array([b]))[0])
        return self.pairs[a, b]

    def _units(self, texts: list[str]) -> np.ndarray:
        """Token counts of whole units."""
        out = np.zeros(len(texts), dtype=np.int64)
        short = [i for i, t in enumerate(texts) if len(t) <= SHORT]
        if short:
            chars = np.frombuffer("".join([texts[i] for i in short]).encode("utf-32-le"), dtype="<u4").astype(np.int64)
            offs = np.r_[0, np.cumsum([len(texts[i]) for i in short])]
            out[short] = self.counts(chars, offs)[0][offs[1:] - 1]
        long = [i for i, t in enumerate(texts) if len(t) > SHORT]
        for i, n in zip(long, self.long_counts([_codes(texts[i]) for i in long])):
            out[i] = n[-1]
        return out

    def prefixes(self, text: str) -> np.ndarray:
        """The token count of every prefix of a text; entry i is for its first i + 1 characters."""
        return self.all_prefixes([text])[0]

    def all_prefixes(self, texts: list[str]) -> list[np.ndarray]:
        """The same for many texts side by side."""
        return [n[1:] for n in self.long_counts([_codes(SPACE + t.replace(" ", SPACE)) for t in texts])]

    def totals_of(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Token counts of rows of text: the last entries of their prefixes."""
        if len(self.place) > KEPT:
            self.clear()
        rows = len(offsets) - 1
        starts, ends, first = word_spans(buf, offsets, _BREAKS)
        space = buf == 0x20
        # the number of spaces right before each place, within its row
        solid = np.where(space, -1, np.arange(len(buf)))
        solid = np.maximum.accumulate(solid) if len(buf) else solid
        row = np.searchsorted(first, np.arange(len(starts)), "right") - 1
        before = np.where(starts > 0, solid[starts - 1], -1) if len(starts) else starts
        m = starts - 1 - np.maximum(before, offsets[row] - 1)
        m = m + (starts - m == offsets[row])
        out = np.zeros(rows, dtype=np.int64)
        # white space that no word follows, and the space that stands before every text
        other = np.flatnonzero((buf >= 0x09) & (buf <= 0x0A))
        of = np.searchsorted(offsets, other, "right") - 1
        np.add.at(out, of, 1)
        tails = np.concatenate([other, offsets[1:][np.diff(offsets) > 0]])
        of = np.concatenate([of, np.flatnonzero(np.diff(offsets) > 0)])
        run = tails - 1 - np.maximum(np.where(tails > 0, solid[tails - 1], -1), offsets[of] - 1) if len(tails) else tails
        run = run + (tails - run == offsets[of])
        for length in np.unique(run[run > 0]).tolist():
            np.add.at(out, of[run == length], int(self._units([SPACE * length])[0]))
        if len(starts):
            hashes = span_hashes(buf, starts, ends) ^ mix(m.astype(U64))
            codes, keys = pd.factorize(hashes)
            at = np.empty(len(keys), dtype=np.int64)
            at[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            found = np.array(list(map(self.place.get, keys.tolist(), [-1] * len(keys))), dtype=np.int64)
            new = np.flatnonzero(found < 0)
            if len(new):
                whole, at = buf.tobytes(), at[new]
                units = [SPACE * k + whole[a:b].decode("utf-8", "replace") for k, a, b in zip(m[at].tolist(), starts[at].tolist(), ends[at].tolist())]
                found[new] = self._units(units)
                self.place.update(zip(keys[new].tolist(), found[new].tolist()))
            out += np.diff(np.r_[0, np.cumsum(found[codes])][first])
        mark = np.frombuffer(SPACE.encode(), dtype=np.uint8)
        strange = np.flatnonzero((buf[:-2] == mark[0]) & (buf[1:-1] == mark[1]) & (buf[2:] == mark[2])) if len(buf) > 2 else starts[:0]
        odd = np.unique(np.searchsorted(offsets, strange, "right") - 1).tolist()
        for i, n in zip(odd, self.all_prefixes([buf[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in odd])):
            out[i] = n[-1]
        return out


@functools.cache
def prefix_counter(path: str) -> PrefixCounter:
    """One counter for each vocabulary file and process."""
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row.

    Null or empty text: no bytes and no tokens. Repeated rows, null ids and
    other columns change nothing; an empty table gives an empty result.
    """

    def f(rows, buf, offsets):
        n = prefix_counter(path).totals_of(buf, offsets)
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(by_slices(f), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and counts (array<int>): the exact token count of every prefix, by its number of characters less one.

    The last entry is the count of the whole text. Null or empty text: no
    entries. Repeated rows, null ids and other columns change nothing; an empty
    table gives an empty result.
    """

    def f(rows, buf, offsets):
        texts = [buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
        n = prefix_counter(path).all_prefixes(texts)
        at = np.r_[0, np.cumsum([len(x) for x in n])]
        return pa.RecordBatch.from_arrays([rows.column(0), lists(np.concatenate([*n, np.zeros(0, dtype=np.int64)]).astype(np.int32), at, pa.int32())], ["doc_id", "counts"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(by_slices(f, most=1 << 20), "doc_id long, counts array<int>")


def longest_prefix(counts: Column, budget: int) -> Column:
    """Characters of the longest prefix of at most so many tokens, from stored counts; null counts give 0."""
    fits = F.filter(F.transform(counts, lambda n, i: F.when(n <= budget, i + 1)), lambda i: i.isNotNull())
    return F.coalesce(F.array_max(fits), F.lit(0)).cast("long")


def within_budgets(docs: DataFrame, path: str, budgets: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and cuts: for each budget the longest prefix, in characters, of at most so many tokens.

    One pass of the prefix counts answers all budgets; nothing is encoded
    again. Null or empty text: 0. Repeated rows, null ids and other columns
    change nothing; an empty table gives an empty result.
    """
    made = prefix_counts(docs, path, id_col, text_col)
    return made.select("doc_id", F.array(*[longest_prefix(F.col("counts"), b) for b in budgets]).alias("cuts"))
