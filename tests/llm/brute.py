"""Plain versions of the operators, for small inputs."""

import re
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_bag(text):
    w = WORD.findall((text or "").translate(LOWER))
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def groups(rows):
    """Smallest doc_id reachable by links, per row of (doc_id, text); None ids never name a group with another id."""
    sets = [frozenset(shingle_bag(t)) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


def covered(texts, length=200):
    """Mask per text of the bytes covered by strings that also start elsewhere."""
    seen = Counter(b[p:p + length] for b in texts for p in range(len(b) - length + 1))
    out = []
    for b in texts:
        m = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                m[p] += 1
                m[p + length] -= 1
        out.append(np.cumsum(m)[:len(b)] > 0)
    return out


def cut(b, mask):
    return np.frombuffer(b, np.uint8)[~mask].tobytes() if b else b""


def held_items(text, items, threshold=0.8):
    doc = set(shingle_bag((text or "").lower()))
    out = {}
    for i, t in items:
        item = set(shingle_bag((t or "").lower()))
        if item and len(doc & item) / len(item) >= threshold:
            out[i] = len(doc & item) / len(item)
    return out
