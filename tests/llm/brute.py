"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def substring(docs, window=13):
    """docs: (doc_id, text). -> {(doc_id, text): (n_words, n_removed, sha)}"""
    first = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def byte_repeats(docs, width=100):
    seen, out = set(), []
    for i, t in sorted(docs, key=lambda d: d[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            g = b[k : k + width]
            if g in seen:
                gone[k : k + width] = b"\1" * width
            seen.add(g)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def byte_groups(docs, places, width=100, gram=24):
    """Maximal repeats within the contexts of ``places`` (doc_id -> starts of anchors): {(first id, first start, length, id, start)}.

    An anchor counts for strings it is the least gram of a window of; what it
    finds is compared with every occurrence in the texts.
    """
    before, data = width - gram, {i: (t or "").encode() for i, t in docs}
    by_gram = defaultdict(list)
    for i, starts in places.items():
        for at in starts:
            by_gram[data[i][at : at + gram]].append((i, at))
    out = set()
    for found in by_gram.values():
        for a in range(before + 1):
            for b in range(width - a, width + 1):
                same = defaultdict(list)
                for i, at in found:
                    if at >= a and at + b <= len(data[i]):
                        same[data[i][at - a : at + b]].append((i, at - a))
                for string, where in same.items():
                    ends = {(i, s, a + b) for i, s in where}
                    lefts = {data[i][s - 1] if s else (i, s) for i, s in where}
                    rights = {data[i][s + a + b] if s + a + b < len(data[i]) else (i, s) for i, s in where}
                    if len(ends) > 1 and (a == before or len(lefts) > 1) and (b == width or len(rights) > 1):
                        out.add((string, a))
    return data, out


def occurrences(data, string):
    out = []
    for i, b in data.items():
        k = b.find(string)
        while k >= 0:
            out.append((i, k))
            k = b.find(string, k + 1)
    return sorted(out)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(text, n=4):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) or frozenset([tuple(w)])


def near(docs, n=4):
    sets = [(i, shingles(t, n)) for i, t in docs]
    by = defaultdict(list)
    for j, (_, s) in enumerate(sets):
        for g in s:
            by[g].append(j)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for j, (_, s) in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for k in by[g]:
                if k < j:
                    shared[k] += 1
        for k, c in shared.items():
            if 100 * c >= 80 * (len(s) + len(sets[k][1]) - c):
                parent[root(j)] = root(k)
    least = {}
    for j, (i, _) in enumerate(sets):
        r = root(j)
        least[r] = min(least.get(r, i), i)
    return sorted((i, len(s), least[root(j)], i == least[root(j)]) for j, (i, s) in enumerate(sets))
