"""Vertical Hamming comparison: many distances at once on bit planes.

A block of m fingerprints is stored as one plane per bit, 64 fingerprints to a machine word. For a
query, plane XOR query bit gives a difference bit for 64 fingerprints at once. Difference bits are
added to binary counters that are themselves planes: carry-save adders fold seven of them to three,
which ripple into counters preset so that passing the radius overflows. A lane that overflowed is
dead, and a query leaves the block as soon as all its lanes are.
"""

from __future__ import annotations

import numpy as np

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def planes_of(prints: np.ndarray) -> np.ndarray:
    """(m, words) fingerprints to (bits, ceil(m / 64)) planes; lane k of a plane is fingerprint k."""
    m = len(prints)
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(m, -1), axis=1, bitorder="little")
    full = np.zeros((bits.shape[1], -(-m // 64) * 64), np.uint8)
    full[:, :m] = bits.T
    return np.packbits(full, axis=1, bitorder="little").view(np.uint64)


def _full_add(a, b, c):
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


def close_pairs(prints: np.ndarray, radius: int, chunk: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of fingerprints that differ in at most `radius` bits. Exact."""
    m = len(prints)
    planes = planes_of(prints)
    n_bits, words = planes.shape
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(m, -1), axis=1, bitorder="little")
    masks = (np.uint64(0) - bits.astype(np.uint64)).T  # (bits, m): all ones where the query's bit is set
    depth = max(3, (radius + 1).bit_length())
    preset = (1 << depth) - 1 - radius
    left, right = [], []
    for at in range(0, m, chunk):
        upto = min(at + chunk, m)
        first = at // 64  # lanes before the chunk were queries already
        rows = np.arange(at, upto)
        part = planes[:, first:]
        count = [np.full((len(rows), words - first), ONES if preset >> k & 1 else 0, np.uint64) for k in range(depth)]
        dead = np.zeros((len(rows), words - first), np.uint64)
        for b in range(0, n_bits, 7):
            d = [part[k][None, :] ^ masks[k][rows][:, None] for k in range(b, min(b + 7, n_bits))]
            d += [np.zeros_like(dead)] * (7 - len(d))
            s1, c1 = _full_add(d[0], d[1], d[2])
            s2, c2 = _full_add(d[3], d[4], d[5])
            one, c3 = _full_add(s1, s2, d[6])
            two, four = _full_add(c1, c2, c3)
            carry = np.zeros_like(dead)
            for k, x in enumerate((one, two, four)):
                count[k], carry = _full_add(count[k], x, carry)
            for k in range(3, depth):
                count[k], carry = count[k] ^ carry, count[k] & carry
            dead |= carry
            if b >= 7:
                live = (dead != ONES).any(axis=1)
                if not live.all():
                    rows, dead, count = rows[live], dead[live], [c[live] for c in count]
                    if not len(rows):
                        break
        if len(rows):
            hit = np.unpackbits((~dead).view(np.uint8), axis=1, bitorder="little")
            i, j = np.nonzero(hit)
            i, j = rows[i], j + first * 64
            keep = (j > i) & (j < m)
            left.append(i[keep])
            right.append(j[keep])
    if not left:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(left), np.concatenate(right)


def forest(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of m items the smallest item connected to it through the pairs."""
    root = np.arange(m)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        np.minimum.at(root, before[i], low)
        np.minimum.at(root, before[j], low)
        root = root[root]
        if (root == before).all():
            break
    return root
