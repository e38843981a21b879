"""The filter audit against a plain replay of every order."""

import re
from itertools import permutations

from helpers import DOCUMENTS
from pyspark.sql import functions as F

from tallyloom.llm import filter_audit

WORDY = " ".join(f"w{k}" for k in range(220))
ROWS = [
    (1, WORDY, "en", "a", 1),
    (2, WORDY, "de", "a", 1),
    (3, WORDY, "en", "a", 1),
    (3, WORDY, "en", "a", 1),
    (4, "SHOUT $ " * 300, "en", "a", 1),
    (5, "same same", None, "a", 1),
    (6, "", "", "a", 1),
    (7, None, "en", None, None),
    (None, None, "en", "a", 1),
    (8, WORDY + " 100%", "en", "a", 1),
    (9, "a b c\x1f" * 400, "fr", "a", 1),
    (10, "x\x0by\x0cz\r" * 100, "fr", "a", 1),
    (11, "ABC" + WORDY * 200, "de", "a", 1),
]
LABELS = [(1, 1, 0), (1, 0, 1), (3, None, 1), (4, 1, None), (8, 1, 0), (99, 1, 1), (None, 1, 1)]


def plain(rows, labels):
    found = []
    for doc_id, text, lang, *_ in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        smaller = any(doc_id is not None and r[0] is not None and r[0] < doc_id and (r[1] or "") == text for r in rows)
        checks = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": smaller,
        }
        has = lambda k: doc_id is not None and any(x[0] == doc_id and x[k] == 1 for x in labels)
        found.append((lang or "", {f for f in checks if checks[f]}, has(1), has(2)))
    out = set()
    for part in {f[0] for f in found}:
        here = [f for f in found if f[0] == part]
        removed = {}
        for order in permutations("ABCDE"):
            left = here
            for k, letter in enumerate(order):
                gone = [f for f in left if letter in f[1]]
                left = [f for f in left if letter not in f[1]]
                earlier = sum(letter in f[1] and bool(f[1] & set(order[:k])) for f in here)
                only = sum(f[1] == {letter} for f in here)
                removed[letter] = removed.get(letter, 0) + len(gone)
                out.add((part, "".join(order), k + 1, len(left), len(gone), earlier, only, sum(f[2] for f in gone), sum(f[3] for f in gone), letter))
        out = {(*r[:9], removed[r[9]]) if len(r) == 10 and r[0] == part else r for r in out}
    return out


def test_equals_a_replay_of_every_order(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(ROWS, DOCUMENTS)
    got = filter_audit.audit(docs, labels)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == 4 * 600 and set(rows) == plain(ROWS, LABELS)
    crowded = docs.withColumns({c: F.lit("x") for c in ("part", "mask", "label", "_own", "_digest", "_first", "_n", "_text", "quality")})
    assert {tuple(r) for r in filter_audit.audit(crowded, labels.withColumn("part", F.lit("y"))).collect()} == set(rows)
    assert filter_audit.audit(docs.where("false"), labels).count() == 0
    unlabelled = filter_audit.audit(docs, labels.where("false"))
    assert unlabelled.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_long_text(spark):
    long = [(1, "one two three, " * 100_000, "en", "a", 1), (2, "one two three, " * 100_000 + "$", "en", "a", 1)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.failure_masks(spark.createDataFrame(long, DOCUMENTS)).collect()
    assert {(r.doc_id, r.mask) for r in got} == {(1, 2), (2, 10)}
    assert filter_audit.audit(spark.createDataFrame(long, DOCUMENTS), labels).count() == 600


def test_transform_inverts(spark):
    counts = [(k * 7919) % 101 for k in range(32)]
    rows = spark.createDataFrame([("p", "all", m) for m in range(32) for _ in range(counts[m])], "part string, label string, mask int")
    assert filter_audit.mask_cells(rows).first()["all"] == counts


def test_query_equals_its_sql(compare):
    assert compare("op11_filter_audit") == 2400
