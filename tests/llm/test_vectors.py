"""Vector codes against a plain search over all entries."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"
SF = "/root/testdata/sf0.01"


def plain(rows, rounds=4):
    """(vec_id, code, error, label_error, digest), in Python integers."""
    kept = [(i, v, l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max([len(v) for _, v, _ in kept] or [1]) // 4) * 4
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v] + [0] * (width - len(v)), l) for i, v, l in kept]
    part = width // 4
    cut = [[v[k * part : (k + 1) * part] for k in range(4)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:256]
    books = [[list(cut[k][p]) for k in first] for p in range(4)]

    def search(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            members = {}
            for c in cut:
                members.setdefault(search(c[p], books[p])[1], []).append(c[p])
            for k, xs in members.items():
                books[p][k] = [sum(col) // len(xs) for col in zip(*xs)]
    final = [[search(c[p], books[p]) for p in range(4)] for c in cut]
    errors = [sum(d for d, _ in f) for f in final]
    by_label = {}
    for (_, _, l), e in zip(kept, errors):
        by_label[l] = by_label.get(l, 0) + e
    text = ",".join(str(x) for book in books for e in book for x in e)
    digest = hashlib.sha256(text.encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in f), e, by_label[l], digest) for (i, _, l), f, e in zip(kept, final, errors)]


def result(spark, rows, crowd=False):
    table = spark.createDataFrame(rows, SCHEMA)
    if crowd:
        table = table.withColumns({c: F.lit("x") for c in ("codes", "error", "vector", "_group", "label_error", "_n", "slot")})
    found, books = vector_codes.compress(table)
    return [(r.vec_id, bytes(r.codes).hex(), r.error, r.label_error, vector_codes.digest(books)) for r in found.collect()]


def some(n, seed, width=8, spread=1.0):
    rng = random.Random(seed)
    return [(k * 3 % (n + 7), [rng.gauss(0, spread) for _ in range(width)], rng.choice([0, 1, 2, None])) for k in range(n)]


@pytest.mark.parametrize("n", [1, 5, 255, 256, 400])
def test_equals_plain_search(spark, n):
    rows = some(n, n)
    assert sorted(result(spark, rows)) == sorted(plain(rows))


def test_defined_cases(spark):
    rows = some(300, 4) + [(7, None, 1), (8, [0.5, None] * 4, 1), (9, [math.nan] * 8, None), (10, [math.inf] * 8, 2), (11, [-math.inf, *[0.0] * 7], 2)]
    rows += [(12, [-0.0001] * 8, None), (12, [-0.0001] * 8, None), (12, [0.3] * 8, 5), (None, [0.1] * 8, 5), (None, None, None)]
    rows += [(500 + k, [0.25] * 8, 0) for k in range(200)]  # one vector many times
    rows += [(900, [1.0, 2.0, 3.0], 1), (901, [], 1), (902, [1e5] * 8, 1), (903, [-1e5] * 8, 1)]
    got = result(spark, rows, crowd=True)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(plain(rows), key=key)
    empty = spark.createDataFrame([], SCHEMA)
    assert vector_codes.compress(empty)[0].count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1)], SCHEMA))[0].count() == 0


def test_ball_holds_every_nearer_or_equal_entry():
    """Small integers give many ties; the search from any entry finds the lowest index of the nearest."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        entries = rng.integers(-3, 4, (rng.integers(1, 40), 3))
        points = rng.integers(-3, 4, (60, 3))
        start = rng.integers(0, len(entries), 60)
        found, least = vector_codes.nearest(points, vector_codes.Codebook(entries), start)
        d = ((points[:, None] - entries[None]) ** 2).sum(2)
        assert (found == d.argmin(1)).all() and (least == d.min(1)).all()


def test_large_components_are_exact():
    a = np.array([[2**27, -(2**27), 5], [1, 2, 3]], np.int64)
    assert vector_codes.squares(a, a)[0, 1] == sum((int(x) - int(y)) ** 2 for x, y in zip(a[0], a[1]))


def test_query_equals_plain_search(spark):
    from tallyloom.llm.registry import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = QUERIES["op13_vector_codes"](spark, SF).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows))
