"""Packing of tokenized documents into sequences of a fixed length."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.arrow import by_slices
from cellgrove.llm.bpe import encoded, word_encoder
from cellgrove.llm.shared import Store, text_key

#: Pieces packed together by one task: a bound of memory. What a cell leaves underfull meets that of other cells later.
CELL = 2048
#: Turns on end that save no sequence after which the search is over.
STALE = 2
#: Further starts of the search in the last cell, while no packing is known to have fewer sequences.
STARTS = 6
_FAR = np.iinfo(np.int64).max
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of items, longest first, each into the fullest bin that has room for it."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = {}
    free = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = free >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
        else:
            r, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        if r > n:
            room.setdefault(r - n, []).append(b)
            free |= 1 << (r - n)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Exchange items between underfull bins while the sum of squared fills grows, until bins are empty.

    The least filled bin gives: it moves an item into a fuller one, or
    exchanges one for one, two for one, or one for two, whichever leaves that
    bin the least room (of equal ones the step that moves most). A bin that is
    at least as full grows by what the other loses, so squared fill grows with
    every step and the search ends, at a packing that no such step improves.
    What is left of room gathers in as few bins as the steps can bring it to.
    """
    bins = [list(b) for b in bins if b]
    fill = np.array([sum(lengths[i] for i in b) for b in bins], dtype=np.int64)
    pool = _Pool({b: _Takes(bins[b], lengths) for b in np.flatnonzero(fill < size).tolist()}, size - fill)
    changed = True
    while changed:
        changed = False
        for src in sorted(pool.sets, key=lambda b: (fill[b], b)):
            while src in pool.sets and len(pool.sets) > 1:
                step = pool.step(src)
                if step is None:
                    break
                dst, gain, out, back = step
                bins[src] = [i for i in bins[src] if i not in out] + back
                bins[dst] = [j for j in bins[dst] if j not in back] + out
                fill[src] -= gain
                fill[dst] += gain
                for b in (src, dst):
                    pool.put(b, _Takes(bins[b], lengths) if 0 < fill[b] < size else None, size - int(fill[b]))
                changed = True
    return [b for b in bins if b]


class _Takes:
    """What a bin may give: an item, or two, one choice for each sum of different lengths; sums and the items."""

    def __init__(self, items: list[int], lengths: list[int]):
        by: dict[int, list[int]] = {}
        for i in items:
            by.setdefault(lengths[i], []).append(i)
        n = sorted(by)
        self.one = np.array(n, dtype=np.int64)
        self.one_of = [(by[k][0],) for k in n]
        two = {a + b: (by[a][0], by[b][0]) for x, a in enumerate(n) for b in n[x + 1 :]}
        two |= {2 * a: (by[a][0], by[a][1]) for a in n if len(by[a]) > 1}
        self.two_of = [two[k] for k in sorted(two)]
        self.two = np.array(sorted(two), dtype=np.int64)


class _Pool:
    """What all underfull bins may take back, in flat tables: of nothing, one item and two items.

    A bin that changes leaves dead rows behind and gets new ones at the end; a
    table is made anew when half of it is dead.
    """

    def __init__(self, sets: dict[int, _Takes], room: np.ndarray):
        self.sets, self.room = sets, room.copy()
        self._build()

    def _build(self) -> None:
        self.at, self.n, self.dead, size = {}, [0, 0, 0], 0, [len(self.sets), *(sum(len(getattr(x, k)) for x in self.sets.values()) for k in ("one", "two"))]
        self.take = [np.zeros(2 * n + 64, dtype=np.int64) for n in size]
        self.left = [np.full(2 * n + 64, -1, dtype=np.int64) for n in size]
        self.of = [np.zeros(2 * n + 64, dtype=np.int64) for n in size]
        for b, x in self.sets.items():
            self._add(b, x)

    def _add(self, b: int, x: _Takes) -> None:
        self.at[b] = []
        for k, take in enumerate((np.zeros(1, dtype=np.int64), x.one, x.two)):
            rows = slice(self.n[k], self.n[k] + len(take))
            self.take[k][rows], self.left[k][rows], self.of[k][rows] = take, self.room[b], b
            self.at[b].append(rows)
            self.n[k] = rows.stop

    def put(self, b: int, x: _Takes | None, room: int) -> None:
        """A bin after a step; None when it is full or empty."""
        self._hide(b, -1)
        self.dead += 1
        del self.sets[b]
        self.room[b] = room
        if x is None:
            return
        self.sets[b] = x
        if self.dead > len(self.sets) or any(self.n[k] + n > len(self.take[k]) for k, n in enumerate((1, len(x.one), len(x.two)))):
            self._build()
        else:
            self._add(b, x)

    def _hide(self, b: int, room: int) -> None:
        for k, rows in enumerate(self.at[b]):
            self.left[k][rows] = room

    def step(self, src: int) -> tuple[int, int, list[int], list[int]] | None:
        """The step from a bin that leaves one at least as full the least room: that bin, the gain, the items that go and those that come back."""
        own, best = self.sets[src], None
        self._hide(src, -1)
        for give, items, k in ((own.one, own.one_of, 0), (own.one, own.one_of, 1), (own.two, own.two_of, 1), (own.one, own.one_of, 2)):
            n = self.n[k]
            if not len(give) or not n:
                continue
            take, left = self.take[k][:n], self.left[k][:n]
            at = np.searchsorted(give, take + left, "right") - 1
            gain = give[at] - take
            after = left - gain
            ok = (at >= 0) & (gain > 0) & (left >= 0) & (left <= self.room[src])
            score = np.where(ok, after * (1 << 31) - gain, _FAR)
            i = int(np.argmin(score))
            if ok[i] and (best is None or score[i] < best[0]):
                best = (score[i], items[at[i]], k, i, int(gain[i]))
                if after[i] == 0:
                    break
        self._hide(src, int(self.room[src]))
        if best is None:
            return None
        _, out, k, i, gain = best
        dst = int(self.of[k][i])
        back = () if k == 0 else (self.sets[dst].one_of if k == 1 else self.sets[dst].two_of)[i - self.at[dst][k].start]
        return dst, gain, list(out), list(back)


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, size: int = 2048) -> DataFrame:
    """Documents as pieces of at most `size` ids: doc_id, piece, start, length, ids_crc32 and a key to spread them by.

    A document is the ids of its text and then id 0; only longer ones are cut.
    """
    end = b"\0\0\0\0"

    def f(rows, buf, offsets):
        texts = [x + end for x in encoded(word_encoder(path, 64), buf, offsets)]
        n = np.array([len(x) // 4 for x in texts])
        k = -(-n // size)
        row = np.repeat(np.arange(len(texts)), k)
        piece = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(k)[:-1]], k)
        start = piece * size
        length = np.minimum(size, n[row] - start)
        crc = [zlib.crc32(memoryview(texts[r])[4 * s : 4 * (s + m)]) for r, s, m in zip(row.tolist(), start.tolist(), length.tolist())]
        doc, key = rows.column(0).take(pa.array(row)), rows.column(1).take(pa.array(row))
        return pa.RecordBatch.from_arrays([doc, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), key], ["doc_id", "piece", "start", "length", "ids_crc32", "rid"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(id_col, text_col).alias("rid"), F.col(text_col).alias("text"))
    # the workers stay for the steps that follow, so what they have kept goes with the task
    return rows.mapInArrow(by_slices(f, most=4 << 20, last=lambda: word_encoder(path, 64).clear()), _PIECES + ", rid long")


def _shuffled(bins: list[list[int]], times: int):
    """Other places for a search to start from: a sixth of the bins, at random, taken apart."""
    rng = np.random.default_rng(len(bins))
    for _ in range(times):
        apart = set(rng.permutation(len(bins))[: -(-len(bins) // 6)].tolist())
        yield [b for k, b in enumerate(bins) if k not in apart] + [[i] for k, b in enumerate(bins) if k in apart for i in b]


def _packed(size: int, turn: int, more: int):
    """Pack the pieces of one cell; in later turns they come as the bins of the turn before, which stay if nothing better is found."""

    def f(table: pa.Table) -> pa.Table:
        order = ["sequence_id", "offset"] if turn else ["rid", "piece"]
        table = table.append_column("n", pa.array(range(table.num_rows))).sort_by([(c, "ascending") for c in [*order, "n"]])
        lengths = table["length"].to_pylist()
        starts = [best_fit(lengths, size)]
        if turn:
            first = np.flatnonzero(table["offset"].to_numpy() == 0)
            starts.append([p.tolist() for p in np.split(np.arange(len(lengths)), first[1:])])
        bins, least = None, -(-sum(lengths) // size)
        for start in itertools.chain(starts, _shuffled(starts[-1], more)):
            found = local_search(start, lengths, size)
            bins = found if bins is None or len(found) < len(bins) else bins
            if len(bins) == least:
                break
        at, offset, fill = (np.zeros(len(lengths), dtype=np.int64) for _ in range(3))
        for b, items in enumerate(bins):
            to = 0
            for i in items:
                at[i], offset[i] = b, to
                to += lengths[i]
            fill[items] = to
        base = (turn << 56) | (table["cell"][0].as_py() << 24)
        keep = ["doc_id", "piece", "start", "length", "ids_crc32", "rid"]
        return table.select(keep).append_column("sequence_id", pa.array(at + base)).append_column("offset", pa.array(offset)).append_column("fill", pa.array(fill))

    return f


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, size: int = 2048, cell: int = CELL, name: str = "packing") -> DataFrame:
    """Every piece of every document in a sequence of at most `size` ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset;
    offsets of a sequence are gapless from 0. Pieces are spread over cells of
    about `cell`, a bound of one task's memory. In each, best fit decreasing
    and then exchanges between underfull sequences (local_search) leave few
    that are not full. Those of all cells meet in new cells, turn by turn,
    until no packing can have fewer sequences, or all underfull ones have met
    in one cell, or STALE turns on end empty none.
    Null or empty text: the end id alone. Repeated rows are packed each by
    itself; null ids stay null; other columns are ignored; an empty table gives
    an empty result.
    """
    store = Store(docs.sparkSession, name)
    made = store.put(pieces(docs, path, id_col, text_col, size=size))
    n, total = made.agg(F.count("*"), F.sum("length")).first()
    least, cells, turn, closed, before, stale, done = -(-(total or 0) // size), max(1, round(n / cell)), 0, [], None, 0, 0
    rows = made.withColumn("cell", F.pmod(F.xxhash64("rid", "piece", "ids_crc32"), F.lit(cells)))
    while True:
        out = store.put(rows.groupBy("cell").applyInArrow(_packed(size, turn, STARTS if cells == 1 else 0), _PIECES + ", rid long, sequence_id long, offset long, fill long"))
        full = F.col("fill") == size
        begins = F.col("offset") == 0
        shut, left, n = out.agg(F.count(F.when(begins & full, 1)), F.count(F.when(begins & ~full, 1)), F.count(F.when(~full, 1))).first()
        least, done = least - shut, done + shut
        stale = stale + 1 if done + left == before else 0
        if left <= max(least, 1) or cells == 1 or stale == STALE:
            break
        closed.append(out.where(full))
        turn, before, cells = turn + 1, done + left, max(1, round(n / cell))
        rows = out.where(~full).withColumn("cell", F.pmod(F.xxhash64("sequence_id", F.lit(turn)), F.lit(cells)))
    for x in closed:
        out = out.union(x)
    return out.drop("rid", "fill")
