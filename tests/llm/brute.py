"""Brute-force versions of the operators, on lists of (id, text)."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def low(t):
    return (t or "").translate(LOWER)


def near_duplicates(docs, percent=85):
    """A (n_shingles, component_id, kept) for each row; ids may repeat."""
    sets = []
    for _, t in docs:
        w = WORD.findall(low(t))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(range(len(docs)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            up[root(a)] = root(b)
    least = defaultdict(list)
    for k in range(len(docs)):
        if docs[k][0] is not None:
            least[root(k)].append(docs[k][0])
    out = []
    for k, (i, _) in enumerate(docs):
        c = (min(least[root(k)]) if least[root(k)] else None) if sets[k] else i
        out.append((i, len(sets[k]), c, i is not None and i == c))
    return out


def contamination(docs, bench, n=13):
    windows = defaultdict(set)
    for i, t in bench:
        w = ALNUM.findall(low(t))
        if w and i is not None:
            m = min(n, len(w))
            for k in range(len(w) - m + 1):
                windows[tuple(w[k : k + m])].add(str(i))
    out = []
    for i, t in docs:
        w, hit, items = ALNUM.findall(low(t)), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                found = windows.get(tuple(w[k : k + m]))
                if found:
                    hit.update(range(k, k + m))
                    items |= found
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def repeated_passages(docs, n=35):
    texts = [WORD.findall(t or "") for _, t in docs]
    counts = Counter(tuple(w[k : k + n]) for w in texts for k in range(len(w) - n + 1))
    out = []
    for (i, _), w in zip(docs, texts):
        gone = set()
        for k in range(len(w) - n + 1):
            if counts[tuple(w[k : k + n])] > 1:
                gone.update(range(k, k + n))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


def statistics(docs):
    out = []
    for i, t in docs:
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        counts, gone = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)), set()
        for k in range(len(w) - 4):
            if counts[tuple(w[k : k + 5])] > 1:
                gone.update(range(k, k + 5))
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(gone), len(w) < 10 or 100 * len(gone) > 20 * len(w)))
    return out
