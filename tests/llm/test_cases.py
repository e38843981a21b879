"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest
from helpers import DOCUMENTS
from pyspark.sql import functions as F

from tallyloom.llm import exact_dedup, mixing, near_text, packing, pii, quality, simhash, spotsigs

LONG = "the quick brown fox, it was 4111 1111 1111 1111 and " * 20000
ROWS = [
    (1, LONG, "en", "a", 5),
    (2, "", "en", "a", 0),
    (3, None, None, None, None),
    (4, "same text here of five words", "en", "a", 1),
    (5, "same text here of five words", "en", "b", 1),
    (5, "same text here of five words", "en", "b", 1),
    (None, "null id", "en", "a", 1),
    (6, "é😀\u0000 ퟿", "xx", "a", -1),
]
CLASHING = (
    "keep_id group_size kept text_sha256 spans kind base_sha256 _n _b _own _p tile size fp id node component a b u v m key topic probability sampled _source _tokens"
    " _weight _drawn _probability _rate _score _keep _host _path _log_odds length start offset sequence_id _salt _row _rank r foreign fingerprint near_next is_new batch"
).split()


def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (4, 1, 0), (5, 1, None), (5, 1, None), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "exact": (lambda spark, d: exact_dedup.dedup_batch(d, exact_dedup.DigestIndex(spark)), 8),
    "pii": (lambda spark, d: pii.find_private(d), 8),
    "mixing": (lambda spark, d: mixing.mix(d), 8),
    "packing": (lambda spark, d: packing.pack(d).select("doc_id", "doc_tokens").distinct(), 7),
    "spotsigs": (lambda spark, d: spotsigs.edited_fingerprints(d), 8),
    "simhash": (lambda spark, d: simhash.near_dedup(d), 8),
    "quality": (lambda spark, d: quality.classify(d, labels(spark)), 8),
    "near": (lambda spark, d: near_text.drop_near_duplicates(d), 6),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_rows_with_nulls_repeats_and_clashing_columns(spark, name):
    function, rows = OPERATORS[name]
    docs = spark.createDataFrame(ROWS, DOCUMENTS)
    plain = function(spark, docs)
    columns = [c for c in plain.columns if c not in docs.columns or c == "doc_id"]
    key = lambda r: repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r))
    want = sorted((tuple(r) for r in plain.select(columns).collect()), key=repr)
    assert len(want) == rows
    crowded = docs.withColumns({c: F.lit("x") for c in CLASHING})
    got = sorted((tuple(r) for r in function(spark, crowded).select(columns).collect()), key=repr)
    assert list(map(key, got)) == list(map(key, want))
    assert function(spark, crowded.where("false")).count() == 0
    reordered = sorted((tuple(r) for r in function(spark, docs.repartition(5)).select(columns).collect()), key=repr)
    assert list(map(key, reordered)) == list(map(key, want))


def test_long_text_is_read_to_its_end(spark):
    tail = spark.createDataFrame([(1, LONG, "", "", 0), (2, LONG + "the end all good things", "", "", 0)], DOCUMENTS)
    assert len({r.fingerprint for r in spotsigs.edited_fingerprints(tail).collect()}) == 2
    assert {r.n_card for r in pii.find_private(tail).collect()} == {20000}
    assert len({r.text_sha256 for r in exact_dedup.dedup_batch(tail, exact_dedup.DigestIndex(spark)).collect()}) == 2
    assert sum(r.length for r in packing.pack(tail).collect()) > 400000
