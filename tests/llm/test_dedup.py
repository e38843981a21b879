import random

import numpy as np
import pytest
from helpers import DOCUMENTS, documents, groups, jaccard, shingles, simhash

from tallyloom.llm import bitslice, near_text
from tallyloom.llm import simhash as sh
from tallyloom.llm.common import connected_components
from tallyloom.llm.exact_dedup import DigestIndex, dedup_batch, kept_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op3_warc_revisits"])
def test_against_sql(compare, name):
    assert compare(name) > 0


def test_exact_cases(spark):
    docs = documents(spark, ["Abc", "aBC", None, "", "É", "é", "abc "])
    got = {r.doc_id: r for r in dedup_batch(docs.withColumn("keep_id", docs.doc_id), DigestIndex(spark)).collect()}
    assert [got[k].keep_id for k in range(7)] == [1, 1, 3, 3, 4, 5, 6]
    assert sorted(k for k in got if got[k].kept) == [1, 3, 4, 5, 6]
    assert got[0].group_size == 2 and not got[2].kept


def test_exact_empty_and_repeated(spark):
    assert dedup_batch(documents(spark, []), DigestIndex(spark)).count() == 0
    rows = [(5, "x", "en", "s", 1), (5, "x", "en", "s", 1), (None, "x", "en", "s", 1)]
    got = dedup_batch(spark.createDataFrame(rows, DOCUMENTS), DigestIndex(spark)).collect()
    assert len(got) == 3 and all(r.keep_id == 5 and r.group_size == 3 for r in got)
    assert sum(r.kept for r in got) == 2


def test_index_persists(spark):
    index = DigestIndex(spark)
    dedup_batch(documents(spark, ["a", "b"]), index)
    got = {r.doc_id: r for r in dedup_batch(documents(spark, ["B", "c", "C"], 10), index).collect()}
    assert (got[10].keep_id, got[10].kept) == (1, False)
    assert (got[11].keep_id, got[12].kept) == (12, True)
    assert index.read().count() == 3
    third = dedup_batch(documents(spark, ["c"], 20), index).first()
    assert (third.keep_id, third.kept) == (12, False)
    for _ in range(2):  # a batch run again decides the same
        again = {r.doc_id: r.kept for r in dedup_batch(documents(spark, ["d", "D", "a"], 30), index, "b30").collect()}
        assert again == {30: False, 31: True, 32: False}
    assert index.read().count() == 4
    plan = index.read().join(index.read().hint("merge"), "text_sha256")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan.split("== Physical Plan ==")[1]


def test_index_outlives_the_session(spark):
    name = f"kept_{random.randrange(10**9)}"
    dedup_batch(documents(spark, ["a", "b"]), DigestIndex(spark, name, buckets=3))
    other = spark.newSession()
    spark.sql(f"DROP TABLE {name}")  # as where the catalog ends with the session
    index = DigestIndex(other, name)
    assert index.read().count() == 2 and index.buckets == 3
    got = {r.doc_id: r for r in dedup_batch(documents(other, ["B", "c"], 10), index).collect()}
    assert (got[10].keep_id, got[10].kept, got[11].kept) == (1, False, True)
    plan = index.read().join(index.read().hint("merge"), "text_sha256")._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("== Physical Plan ==")[1]
    index.drop()
    assert DigestIndex(other, name).read().count() == 0


def test_kept_rows_lose_no_text(spark):
    rows = [(5, "a"), (5, "unique"), (9, "A"), (None, "a"), (None, "null only"), (None, "null only"), (7, "x"), (7, "x"), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCUMENTS)
    got = sorted(((r.doc_id, r.text) for r in kept_rows(docs).collect()), key=repr)
    assert got == sorted([(5, "unique"), (9, "A"), (None, "null only"), (7, "x"), (8, None)], key=repr)
    assert kept_rows(docs.where("false")).count() == 0 and kept_rows(docs).columns == docs.columns


def test_hot_digest(spark):
    texts = ["same"] * 3000 + [f"t{k}" for k in range(1500)]
    got = dedup_batch(documents(spark, texts), DigestIndex(spark)).collect()
    assert len(got) == 4500 and sum(r.kept for r in got) == 1501


def near(text, rng, changes):
    w = text.split(" ")
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def texts_with_copies(seed, n=40):
    rng = random.Random(seed)
    out = ["", None, "one", "one two", "  \t\n", "one\xa0two"]
    for _ in range(n):
        base = " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(4, 150)))
        out += [base, base.upper(), near(base, rng, 1), near(base, rng, 2)]
    return out


def test_close_pairs_is_exact():
    rng = np.random.default_rng(5)
    for bits, radius in ((1, 2), (2, 34), (1, 0), (3, 9)):
        base = rng.integers(0, 2**63, (90, bits), dtype=np.uint64)
        near_ones = base[:60].copy()
        for k in range(60):
            for b in rng.integers(0, 64 * bits, k % (radius + 3)):
                near_ones[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        prints = np.concatenate([base, near_ones, base[:5]])
        got = set(zip(*(x.tolist() for x in bitslice.close_pairs(prints, radius, chunk=37))))
        value = [int.from_bytes(p.tobytes(), "little") for p in prints]
        want = {(i, j) for i in range(len(value)) for j in range(i + 1, len(value)) if bin(value[i] ^ value[j]).count("1") <= radius}
        assert got == want and want


def test_forest():
    i, j = np.array([5, 4, 9, 8]), np.array([4, 3, 8, 7])
    assert bitslice.forest(11, i, j).tolist() == [0, 1, 2, 3, 3, 3, 6, 7, 7, 7, 10]


@pytest.mark.parametrize("cap", [4096, 8])
def test_simhash_against_brute_force(spark, cap, monkeypatch):
    monkeypatch.setattr(sh, "CAP", cap)
    monkeypatch.setattr(sh, "TILE", 16 if cap == 8 else 512)
    monkeypatch.setattr(sh.near_links, "__defaults__", (2, cap))
    texts = texts_with_copies(1)
    got = {r.doc_id: r for r in sh.near_dedup(documents(spark, texts)).collect()}
    prints = {k: simhash(t) for k, t in enumerate(texts)}
    assert {k: got[k].fingerprint for k in got} == {k: f"{p:016x}" for k, p in prints.items()}
    want = groups(list(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    assert {k: got[k].component_id for k in got} == want
    assert len(set(want.values())) < len(want) - 40


def test_simhash_empty(spark):
    assert sh.near_dedup(documents(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = {(a, b) for a, b in edges if a is not None and a != b}
    ids = sorted({x for e in real for x in e})
    want = groups(ids, lambda a, b: (a, b) in real or (b, a) in real)
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("cap", [1024, 5])
def test_near_duplicates_against_brute_force(spark, cap, monkeypatch):
    monkeypatch.setattr(near_text, "SET_CAP", cap)
    rng = random.Random(9)
    texts = ["", None, "a b", "a b", "a b c d e"]
    for _ in range(25):
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 200)))
        texts += [base] + [near(base, rng, k) for k in (1, 1, 2, 4)]
    docs = documents(spark, texts).selectExpr("*", "doc_id as component", "text as tile")
    kept = {r.doc_id for r in near_text.drop_near_duplicates(docs).collect()}
    sets = {k: set(shingles(t, 5)) for k, t in enumerate(texts)}
    want = groups(list(sets), lambda a, b: bool(sets[a]) and jaccard(sets[a], sets[b]) >= 0.8)
    assert kept == {k for k in want if want[k] == k}
    assert len(kept) < len(texts) - 20


def test_similar_is_exact():
    rng = random.Random(4)
    sets = []
    for _ in range(30):
        base = [rng.randrange(10**9) for _ in range(rng.randrange(1, 40))]
        sets += [np.unique(base), np.unique(base[: max(1, len(base) * 9 // 10)])]
    root = near_text.similar([s.astype(np.int64) for s in sets], 0.8)
    want = groups(range(len(sets)), lambda a, b: jaccard(sets[a].tolist(), sets[b].tolist()) >= 0.8)
    assert root.tolist() == [want[k] for k in range(len(sets))]


def test_alike_sets_share_a_key():
    rng = np.random.default_rng(4)
    for least in (0.8, 0.55):
        for n in (1, 2, 5, 9, 50, 180, 200):
            frequent = np.sort(rng.integers(0, 400, 60))
            for _ in range(60):
                a = np.unique(rng.integers(0, 400, n))
                b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.9], rng.integers(0, 400, max(1, n // 9)))))
                if jaccard(a.tolist(), b.tolist()) >= least:
                    x, y = (near_text.prefix(s, frequent, least) for s in (a, b))
                    assert set(x.tolist()) & set(y.tolist()), (a, b)


def test_radius_is_five_deviations_out():
    rng = np.random.default_rng(1)
    for n, m in ((5, 4), (45, 36), (450, 360)):
        apart = []
        for _ in range(300):
            h = rng.integers(0, 2**63, n, dtype=np.uint64)
            x, y = near_text.long_print(h, near_text.WORDS), near_text.long_print(h[:m], near_text.WORDS)
            apart.append(int(np.unpackbits((x ^ y).view(np.uint8)).sum()))
        assert np.mean(apart) + 4.5 * np.std(apart) < near_text.RADIUS


def test_near_duplicates_lose_no_row(spark):
    """Ids that are null or repeat with other texts: every text stays unless one like it does."""
    rng = random.Random(12)
    base = " ".join(f"w{rng.randrange(3000)}" for _ in range(120))
    other = " ".join(f"v{rng.randrange(3000)}" for _ in range(120))
    rows = [(1, base), (1, other), (2, near(base, rng, 1)), (None, near(other, rng, 1)), (None, "all alone here in this text"), (7, "x y z"), (7, "x y z"), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCUMENTS)
    kept = sorted(((r.doc_id, r.text) for r in near_text.drop_near_duplicates(docs).collect()), key=repr)
    assert (None, "all alone here in this text") in kept and (8, "") in kept and kept.count((7, "x y z")) == 2
    assert len(kept) == 6 and (1, base) in kept and ((1, other) in kept) != ((None, rows[3][1]) in kept)
