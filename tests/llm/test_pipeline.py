import corpus_pipeline
from helpers import jaccard, shingles, words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage is held against a plain version of what it says, on what the one before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        out = corpus_pipeline.stage(function(spark, docs, SF), name)
        assert out.columns == docs.columns
        after = {r.doc_id: r for r in out.collect()}
        assert after.items() <= before.items()
        kept[name] = (before, after)
        docs = out
    before, after = kept["quality_classifier"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert not [d for d in after if labels.get(d) == 0]
    assert not [d for d in before if labels.get(d) == 1 and d not in after]
    before, after = kept["exact_dedup"]
    last = {}
    for d, r in before.items():
        key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text)
        last[key] = max(d, last.get(key, d))
    assert set(after) == set(last.values())
    before, after = kept["simhash_near_dedup"]
    sets = {d: set(shingles(r.text, 5)) for d, r in before.items()}
    ids = sorted(sets)
    low = {d: d for d in ids}
    for _ in range(4):
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                if jaccard(sets[a], sets[b]) >= 0.8:
                    low[a] = low[b] = min(low[a], low[b])
    assert set(after) == {d for d in ids if low[d] == d}
    assert len(after) < len(before)
    before, after = kept["mixing_weights"]
    share = sum(len(words(r.text)) for r in after.values()) / sum(len(words(r.text)) for r in before.values())
    assert 0.6 < share <= 1.0


def test_stages_lose_nothing(spark):
    """Null and repeated ids, repeated rows, null columns, an empty table, further columns of clashing names."""
    long = " ".join(f"word{k} and some more of it," for k in range(60))
    rows = [(1, long, "en", "a", 5), (1, "unique text of its own", "en", "a", 1), (9, long, None, None, None), (None, long, "en", "a", 1), (None, "nobody has this one", "en", "b", 1),
            (4, None, "en", "a", 0), (5, "", "de", "a", 0), (6, "twice", "en", "a", 1), (6, "twice", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "doc_id as id", "text as kept", "lang as key", "source as tile")
    got = docs
    for name, function in corpus_pipeline.STAGES[1:3]:
        got = corpus_pipeline.stage(function(spark, got, SF), name)
        assert got.columns == docs.columns
    texts = sorted((r.doc_id, r.text) for r in got.where("doc_id is not null").collect())
    assert texts == [(1, "unique text of its own"), (5, ""), (6, "twice"), (9, long)]
    assert [r.text for r in got.where("doc_id is null").collect()] == ["nobody has this one"]
    mixed = corpus_pipeline.STAGES[3][1](spark, got, SF)
    assert mixed.columns == docs.columns and {r.text for r in mixed.collect()} <= {r.text for r in got.collect()}
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, docs.where("false"), SF).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for seq in {r.sequence_id for r in rows}:
        assert sum(r.length for r in rows if r.sequence_id == seq) <= 1024
