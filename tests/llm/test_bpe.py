"""Byte-level BPE against tiktoken, and the round trip."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import DOCUMENTS, documents
from pyspark.sql import functions as F

from tallyloom.llm import bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoding():
    with open(public_tokenizers.path(bpe.RANKS), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(text, split):
    return np.frombuffer(b"".join(bpe.replay([w.encode() for w in split(text)], bpe.vocabulary())), "<i4").tolist()


@pytest.fixture(scope="module")
def split():
    return bpe.splitter(bpe.disputed())


def test_texts_of_any_kind(encoding, split):
    rng = random.Random(5)
    odd = [chr(c) for c in rng.sample(sorted(bpe.disputed()), 500)]
    pool = odd + list("aA1!' \n\t\r_é的😀ßñ\x85\xa0　\x1c\x00sl ٣Ⅷ²") * 10
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(14)))
        assert "".join(split(text)) == text
        assert ids_of(text, split) == encoding.encode_ordinary(text), repr(text)


@pytest.mark.parametrize("text", ["a" * 60_000, "ab" * 30_000, " " * 5000 + "x", "\n" * 999, "的" * 9000, "<|endoftext|>", "don't 'LL 12345 x"])
def test_long_words_and_marks(encoding, split, text):
    assert ids_of(text, split) == encoding.encode_ordinary(text)


def test_any_table_of_ranks():
    """Ranks in no order of training: merged tokens may open pairs of lower rank."""
    rng = random.Random(9)
    for _ in range(150):
        extra = list({bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(40)})
        rng.shuffle(extra)
        ranks = {bytes([b]): b for b in range(256)} | {e: 256 + k for k, e in enumerate(extra)}
        whole = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(25)]
        for word, ids in zip(words, bpe.replay([w.encode() for w in words], bpe.Vocabulary(ranks))):
            assert ids == bpe.packed(whole.encode_ordinary(word))


def test_defined_cases(spark, encoding):
    rng = random.Random(2)
    texts = ["", None, "x", "x", "\x00", "w " * 100_000] + [" ".join(f"w{rng.randrange(90)}" for _ in range(60)) for _ in range(40)]
    docs = documents(spark, texts).unionByName(spark.createDataFrame([(None, "null id", None, None, None), (2, "x", "", "", 0)], DOCUMENTS))
    want = sorted([(k, encoding.encode_ordinary(t or "")) for k, t in enumerate(texts)] + [(2, encoding.encode_ordinary("x")), (-1, encoding.encode_ordinary("null id"))])
    for most in (bpe.FREQUENT, 5, 0):  # the size of the table changes nothing
        got = bpe.encode(docs.withColumns({c: F.lit("z") for c in ("ids", "word", "n", "k", "t", "_text")}), most=most)
        rows = got.withColumn("back", bpe.decoded(F.col("ids"))).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids) for r in rows) == want
        assert {bytes(r.back) for r in rows} == {(t or "").encode() for t in [*texts, "null id"]}
    assert bpe.encode(docs.where("false")).count() == 0


def test_table_keeps_its_bound(spark):
    docs = documents(spark, [" ".join(f"w{k % 37}x{k % 11}" for k in range(n)) for n in range(60)])
    for most in (0, 7, 30, 1000):
        assert bpe.frequent_words(docs, most=most).count() <= most
    assert bpe.frequent_words(docs, most=1000).count() > 30


def test_query_equals_tiktoken(spark, encoding):
    from tallyloom.llm.registry import QUERIES

    got = {r.doc_id: r for r in QUERIES["op12_byte_bpe"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids, found = encoding.encode_ordinary(r.text or ""), got.pop(r.doc_id)
        assert found.n_tokens == len(ids)
        assert found.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert not got
