"""Plain versions of the corpus operators, written from their definitions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return WORD.findall(text)


def substring_dedup(rows, window=20):
    first = {}
    for doc, text in rows:
        w = words(text)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            place = (-math.inf if doc is None else doc, s)
            first[k] = min(first.get(k, place), place)
    out = []
    for doc, text in rows:
        w, gone = words(text), set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (-math.inf if doc is None else doc, s):
                gone.update(range(s, s + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, k=5):
    w = words(text, True)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def shingle_components(rows):
    sets = [(doc, shingles(text)) for doc, text in rows]
    up = {doc: doc for doc, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for g in s:
            by[g].append(i)
    for i, (doc, s) in enumerate(sets):
        shared = Counter(j for g in s for j in by[g] if j < i)
        for j, n in shared.items():
            if doc is not None and sets[j][0] is not None and 100 * n >= 80 * (len(s) + len(sets[j][1]) - n):
                a, b = find(doc), find(sets[j][0])
                up[max(a, b)] = min(a, b)
    return [(doc, len(s), None if doc is None else find(doc)) for doc, s in sets]


def crc_bucket(doc, mod):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % mod


def base_scores(rows):
    count, n = Counter(), 0
    for doc, text in rows:
        if crc_bucket(doc, 7) != 2:
            count.update([*words(text, True), None])
    n, v = sum(count.values()), len(count)
    out = []
    for doc, text in rows:
        t = [*words(text, True), None]
        out.append((doc, crc_bucket(doc, 7) == 2, len(t), sum(count[x] > 0 for x in t), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t)))
    return out
