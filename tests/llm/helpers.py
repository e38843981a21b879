"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re
from itertools import combinations

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, start=0):
    rows = [(start + k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]


def shingles(text, width):
    w = words(text)
    if not w:
        return []
    if len(w) < width:
        return [" ".join(w)]
    return [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)]


def simhash(text):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def groups(ids, linked):
    """Smallest id reachable over linked pairs."""
    low = {i: i for i in ids}
    changed = True
    pairs = [(a, b) for a, b in combinations(ids, 2) if linked(a, b)]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low
