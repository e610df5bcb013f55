"""Plain definitions of results, one document or pair at a time."""

import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < n:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def components(docs, percent=75):
    """doc_id -> smallest reachable id; docs: (doc_id, text), ids may repeat."""
    sets = [(i, shingles(t)) for i, t in docs if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def kept_words(docs, window=20):
    """Position of each row's words that stay; docs in (doc_id, text); equal rows count once."""
    order = {d: k for k, d in enumerate(sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0)))}
    first = {}
    for d in order:
        w = WORD.findall(d[1] or "")
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (order[d], i))
    out = defaultdict(list)
    for d in order:
        w = WORD.findall(d[1] or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (order[d], i):
                gone[i : i + window] = [True] * window
        out[d] = [x for x, g in zip(w, gone, strict=True) if not g]
    return out


class KneserNey:
    """Interpolated modified Kneser-Ney over the bytes of texts, zeros before each."""

    def __init__(self, texts, order):
        self.order, level = order, Counter()
        for t in texts:
            b = bytes(order - 1) + t.encode()
            level.update(b[i : i + order] for i in range(len(b) - order + 1))
        self.levels = {order: level}
        for k in range(order - 1, 0, -1):
            self.levels[k] = Counter(g[1:] for g in self.levels[k + 1])
        self.discounts, self.by_context = {}, {}
        for k, level in self.levels.items():
            n = [sum(v == i for v in level.values()) for i in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
            out = []
            for i in (1, 2, 3):
                d = i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else (out[-1] if out else y)
                out.append(min(max(d, 0.05), i - 0.05))
            self.discounts[k] = out
            self.by_context[k] = defaultdict(list)
            for g, v in level.items():
                self.by_context[k][g[:-1]].append(v)

    def p(self, gram):
        if not gram:
            return 1 / 256
        k = len(gram)
        below, around = self.p(gram[1:]), self.by_context[k].get(gram[:-1])
        if not around:
            return below
        off = lambda v: self.discounts[k][min(v, 3) - 1] if v else 0.0
        n = self.levels[k].get(gram, 0)
        return (n - off(n)) / sum(around) + sum(map(off, around)) / sum(around) * below

    def nats(self, text):
        b = bytes(self.order - 1) + text.encode()
        return -sum(math.log(self.p(b[i : i + self.order])) for i in range(len(b) - self.order + 1))
