"""A byte-pair encoder with word ends, for many words at once.

It gives the ids that the tokenizers library gives for the same vocabulary
file. A text splits at ASCII white space whatever else stands in it, so words
are are encoded once and kept by their hash. Words of letters, digits and marks of
ASCII and Latin-1 are split and merged here, all words of a batch side by side.
Other words are split by the library's own normalizer and rules; long pieces of
them are merged here as well, so that unsplit text of any script is a tree, and
short words go to the library whole.
"""

from __future__ import annotations

import functools
import itertools
import json

import numpy as np
import pandas as pd

from cellgrove.llm.words import U64, span_hashes, word_spans

_NONE = np.iinfo(np.int64).max
#: Pieces kept before the store starts anew: a bound of memory, not of results.
KEPT = 1_000_000
#: Bytes of their ids that are kept at most.
KEPT_BYTES = 64 << 20
#: Symbols of one piece above which halves are encoded and then joined.
LEAF = 16
# the byte alphabet of byte-level vocabularies: printable bytes stand for themselves, the others for 256, 257, ...
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
# classes of bytes: 1 letters, 2 digits, 0 other marks; 3: a word with such a byte goes to the library
_KIND = np.full(256, 3, dtype=np.uint8)
_KIND[0x21:0x7F] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[ord("'")] = 3
_DOWN = np.arange(256, dtype=np.uint8)
_DOWN[65:91] += 32


def byte_alphabet() -> list[str]:
    """The character that stands for each byte."""
    rest = iter(range(256, 512))
    return [chr(b) if b in set(_PRINTABLE) else chr(next(rest)) for b in range(256)]


class Merger:
    """Merges of pairs by rank, over many symbol sequences at once."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray, made: np.ndarray, sizes: np.ndarray):
        """pairs[i] merges at ranks[i], the lowest and then the leftmost first, to the id made[i]; sizes: symbols of each id."""
        keys = (pairs[:, 0].astype(np.int64) << 20) | pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made, self.sizes = keys[order], ranks[order].astype(np.int64), made[order], sizes

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a << 20) | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE)

    def merge(self, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets; offsets[i] .. offsets[i + 1] are the symbols of sequence i, at least one."""
        n = len(offsets) - 1
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ids, which, offs = symbols.astype(np.int64), np.arange(n), offsets.astype(np.int64)
        rank = np.full(len(ids), _NONE)
        if len(ids) > 1:
            rank[:-1] = self.rank(ids[:-1], ids[1:])
        rank[offs[1:] - 1] = _NONE
        while len(which):
            least = np.minimum.reduceat(rank, offs[:-1])
            going = least < _NONE
            lengths = np.diff(offs)
            if not going.all():
                done = ~going
                mask = np.repeat(done, lengths)
                out.append((which[done], ids[mask], lengths[done]))
                ids, rank, which, lengths, least = ids[~mask], rank[~mask], which[going], lengths[going], least[going]
                offs = np.r_[0, np.cumsum(lengths)]
                if not len(which):
                    break
            at = np.flatnonzero(rank == np.repeat(least, lengths))
            of = np.searchsorted(offs, at, "right") - 1
            at = at[np.r_[True, of[1:] != of[:-1]]]
            ids[at] = self.made[np.searchsorted(self.keys, (ids[at] << 20) | ids[at + 1])]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            rank[at] = rank[at + 1]
            ids, rank = ids[keep], rank[keep]
            at -= np.arange(len(at))
            offs = offs - np.arange(len(offs))
            left = at[at > offs[:-1]]
            rank[left - 1] = self.rank(ids[left - 1], ids[left])
            right = at[at + 1 < offs[1:]]
            rank[right] = self.rank(ids[right], ids[right + 1])
            rank[offs[1:] - 1] = _NONE
        which = np.concatenate([x[0] for x in out]) if out else np.zeros(0, dtype=np.int64)
        flat = np.concatenate([x[1] for x in out]) if out else np.zeros(0, dtype=np.int64)
        lengths = np.concatenate([x[2] for x in out]) if out else np.zeros(0, dtype=np.int64)
        return _in_order(flat, lengths, which)

    def trees(self, texts: list[np.ndarray], leaf: int = LEAF) -> list[np.ndarray]:
        """Ids of long sequences: of their halves' halves, all in one batch, then joined two by two."""
        parts = []
        for symbols in texts:
            n = 1 << max(0, int(np.ceil(np.log2(max(1, len(symbols) / leaf)))))
            cuts = np.linspace(0, len(symbols), n + 1).astype(np.int64)
            parts.append([symbols[a:b] for a, b in zip(cuts[:-1], cuts[1:])])
        flat = [x for p in parts for x in p]
        ids = iter(zip(flat, self._batch(flat)))
        parts = [[next(ids) for _ in p] for p in parts]
        while any(len(p) > 1 for p in parts):
            two = iter(self._joined([(p[i], p[i + 1]) for p in parts for i in range(0, len(p) - 1, 2)]))
            parts = [[next(two) for _ in range(len(p) // 2)] if len(p) > 1 else p for p in parts]
        return [p[0][1] for p in parts]

    def _batch(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        flat, offs = self.merge(np.concatenate(texts), np.r_[0, np.cumsum([len(x) for x in texts])])
        return np.split(flat, offs[1:-1])

    def _joined(self, pairs):
        """Neighbours (symbols, ids) made one: the window around each join is encoded anew and grows until both sides agree.

        A sequence of ids is the encoding of its text if and only if each two
        neighbours in it are the encoding of theirs. A window that keeps the
        first of its ids on the left and the last on the right leaves only
        neighbours that some encoding has put side by side.
        """
        out, width, open_ = [None] * len(pairs), 2, list(range(len(pairs)))
        while open_:
            windows, places = [], []
            for k in open_:
                (ls, li), (rs, ri) = pairs[k]
                i, j = max(0, len(li) - width), min(len(ri), width)
                a, b = int(self.sizes[li[i:]].sum()), int(self.sizes[ri[:j]].sum())
                windows.append(np.concatenate([ls[len(ls) - a :], rs[:b]]))
                places.append((i, j))
            again = []
            for k, (i, j), ids in zip(open_, places, self._batch(windows)):
                (ls, li), (rs, ri) = pairs[k]
                if (i == 0 or ids[0] == li[i]) and (j == len(ri) or ids[-1] == ri[j - 1]):
                    out[k] = (np.concatenate([ls, rs]), np.concatenate([li[:i], ids, ri[j:]]))
                else:
                    again.append(k)
            open_, width = again, width * 2
        return out


def _in_order(flat, lengths, which):
    """Ragged rows, row k of which belongs at place which[k]."""
    offs = np.r_[0, np.cumsum(lengths)]
    order = np.argsort(which, kind="stable")
    n = lengths[order]
    to = np.r_[0, np.cumsum(n)]
    return flat[np.repeat(offs[order] - to[:-1], n) + np.arange(len(flat))], to


def _pieces(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """The text with its pieces: their starts, ends, the number before each word, and which of them the library encodes.

    Letters of ASCII and Latin-1 are lowered and stand together, as other marks
    do; digits stand alone. A word with any other character, an apostrophe (the
    vocabulary has rules for it) or the start of a special token is one odd piece.
    """
    kind, low = _KIND[buf], _DOWN[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    lead = lead[(buf[lead + 1] >= 0x80) & (buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = 1
    upper = lead[buf[lead + 1] <= 0x9E] + 1
    low[upper] += 0x20
    kind[:-1][(buf[:-1] == 0x3C) & (buf[1:] == 0x7C)] = 3
    bad = np.r_[0, np.cumsum(kind == 3)]
    odd_word = bad[ends] > bad[starts]
    cut = np.zeros(len(buf) + 1, dtype=bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    inside = np.zeros(len(buf) + 1, dtype=np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    cut &= np.cumsum(inside, dtype=np.int8) > 0
    for a, b in zip(starts[odd_word].tolist(), ends[odd_word].tolist()):
        cut[a:b] = False
        low[a:b] = buf[a:b]
    cut[starts] = True
    at = np.flatnonzero(cut)
    first = np.searchsorted(at, starts)
    until = np.r_[at[1:], 0]
    until[np.r_[first[1:], len(at)] - 1] = ends
    odd = np.zeros(len(at), dtype=bool)
    odd[first[odd_word]] = True
    return low, at, until, np.r_[first, len(at)], odd


class WordEncoder:
    """Ids of words for a vocabulary with word ends, kept by hash."""

    def __init__(self, path: str, leaf: int = LEAF):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        vocab, merges = kind["model"]["vocab"], kind["model"]["merges"]
        end = kind["model"]["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        sizes = np.ones(max(vocab.values()) + 1, dtype=np.int64)
        for t, i in vocab.items():
            sizes[i] = len(t.removesuffix(end))
        made = np.array([vocab[a + b] for a, b in merges])
        self.merger = Merger(np.array([(vocab[a], vocab[b]) for a, b in merges]), np.arange(len(merges)), made, sizes)
        self.leaf = leaf
        alphabet = byte_alphabet()
        self.byte_of = {c: b for b, c in enumerate(alphabet)}
        self.inner = np.array([vocab[c] for c in alphabet])
        self.last = np.array([vocab[c + end] for c in alphabet])
        self.token = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size())]
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.ids: list[bytes] = []
        self.held = 0

    def of(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place in self.ids of every piece of the words, and the number of pieces before each word.

        The bytes at a place are ids, little-endian 32-bit. Places hold until the next call.
        """
        if len(self.ids) > KEPT or self.held > KEPT_BYTES:
            self.clear()
        buf, pieces, until, first, odd = _pieces(buf, starts, ends)
        hashes = span_hashes(buf, pieces, until) ^ (odd.astype(U64) * U64(0xA5A5A5A5A5A5A5A5))
        codes, keys = pd.factorize(hashes)
        at = np.empty(len(keys), dtype=np.int64)
        at[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        found = np.fromiter(map(self.place.get, keys.tolist(), itertools.repeat(-1)), dtype=np.int64, count=len(keys))
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = np.arange(len(self.ids), len(self.ids) + len(new))
            self.place.update(zip(keys[new].tolist(), found[new].tolist()))
            whole, at = buf.tobytes(), at[new]
            raw = [whole[a:b] for a, b in zip(pieces[at].tolist(), until[at].tolist())]
            strange = odd[at].tolist()
            merged = iter(self._merged([x for x, o in zip(raw, strange) if not o]))
            others = iter(self._others([x.decode("utf-8", "replace") for x, o in zip(raw, strange) if o]))
            made = [next(others) if o else next(merged) for o in strange]
            self.ids += made
            self.held += sum(map(len, made))
        return found[codes], first

    def _others(self, words: list[str]) -> list[bytes]:
        """Ids of words that hold other characters; those that may hold a special token go to the library as well."""
        split = [len(w) > self.leaf and "<|" not in w for w in words]
        pieces = [self._split(w) if s else [] for w, s in zip(words, split)]
        merged = iter(self._merged([x for p in pieces for x in p]))
        whole = [w for w, s in zip(words, split) if not s]
        whole = iter(self.library.encode_batch(whole, add_special_tokens=False) if whole else [])
        return [b"".join([next(merged) for _ in p]) if s else np.array(next(whole).ids, dtype="<u4").tobytes() for p, s in zip(pieces, split)]

    def _split(self, word: str) -> list[bytes]:
        """The pieces of a word as bytes; the library gives them in the byte alphabet."""
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(word))
        return [bytes(map(self.byte_of.__getitem__, x)) for x, _ in split]

    def _merged(self, raw: list[bytes]) -> list[bytes]:
        if not raw:
            return []
        lengths = np.array([len(x) for x in raw])
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.inner[flat]
        symbols[ends - 1] = self.last[flat[ends - 1]]
        short = lengths <= self.leaf
        out = iter([])
        if short.any():
            ids, offs = self.merger.merge(symbols[np.repeat(short, lengths)], np.r_[0, np.cumsum(lengths[short])])
            data, cut = ids.astype("<u4").tobytes(), (offs * 4).tolist()
            out = iter([data[a:b] for a, b in zip(cut[:-1], cut[1:])])
        long = [symbols[e - n : e] for e, n in zip(ends[~short].tolist(), lengths[~short].tolist())]
        trees = iter(self.merger.trees(long, self.leaf) if long else [])
        return [next(out) if s else next(trees).astype("<u4").tobytes() for s in short.tolist()]


@functools.cache
def word_encoder(path: str, leaf: int = LEAF) -> WordEncoder:
    """One encoder for each vocabulary file and process."""
    return WordEncoder(path, leaf)


def pieces_of(encoder: WordEncoder, buf: np.ndarray, offsets: np.ndarray) -> tuple[list[int], list[int]]:
    """The places in encoder.ids of the pieces of all rows, and where each row's begin."""
    starts, ends, first = word_spans(buf, offsets)
    if not len(starts):
        return [], [0] * len(offsets)
    places, before = encoder.of(buf, starts, ends)
    return places.tolist(), before[first].tolist()


def encoded(encoder: WordEncoder, buf: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Ids of every row as bytes, little-endian 32-bit."""
    places, cut = pieces_of(encoder, buf, offsets)
    get = encoder.ids.__getitem__
    return [b"".join(map(get, places[a:b])) for a, b in zip(cut[:-1], cut[1:])]
