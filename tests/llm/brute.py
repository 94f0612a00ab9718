"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w, seen, dup = WORD.findall(text), set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    n, m = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), [False] * len(w)
    for i in range(len(w) - 7):
        if n[tuple(w[i : i + 8])] > 1:
            m[i : i + 8] = [True] * 8
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, sum(m)


def shingles(text, size):
    w = WORD.findall((text or "").translate(_LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def groups(docs, size, percent=80):
    """Rows (doc_id, n_shingles, component_id) of rows (doc_id, text)."""
    sets = [shingles(t, size) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        r = find(k)
        least[r] = i if least.get(r) is None else min(least[r], i) if i is not None else least[r]
    return [(i, len(sets[k]), least[find(k)] if sets[k] else i) for k, (i, _) in enumerate(docs)]


def without_windows(docs, width):
    """Rows (doc_id, n_words, n_removed, sha) of rows (doc_id, text)."""
    words = [WORD.findall(t or "") for _, t in docs]
    n = collections.Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (doc, _), w in zip(docs, words):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if n[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((doc, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def without_later(docs, width):
    """Rows (doc_id, n_bytes, n_removed, n_spans, sha) of distinct rows (doc_id, text)."""
    seen, out = {}, []
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    for k, (_, t) in enumerate(order):
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            seen.setdefault(b[i : i + width], (k, i))
    for k, (doc, t) in enumerate(order):
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] < (k, i):
                gone[i : i + width] = [True] * width
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out
