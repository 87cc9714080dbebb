"""Plain versions of the operators, for small tables."""

import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def jaccard_components(texts, percent=80):
    """Component (smallest row number) of each row."""
    sets, u, by = [shingles(t) for t in texts], Union(), defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in by[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                u.join(i, j)
    return [u.root(i) for i in range(len(sets))], sets


def repeated_bytes(texts, length):
    """(bytes, removed, spans, kept) of each text."""
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if n[d[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        out.append((len(d), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), bytes(b for b, g in zip(d, gone) if not g)))
    return out
