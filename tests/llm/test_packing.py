import random
import zlib

import numpy as np
from helpers import documents

from tallyloom.llm import packing


def test_round_trip(spark):
    rng = random.Random(1)
    texts = ["", None, "x", "a<|endoftext|>b"] + [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 30, 300, 3000]))) for _ in range(60)]
    texts += texts[4:8]
    rows = packing.pack(documents(spark, texts)).collect()
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for k, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 1024
    tokens = sum(r.length for r in rows)
    assert len(by_seq) <= -(-tokens // 1024) * 1.1


def test_tokens_equal_the_tokenizers():
    slow, fast, _ = packing._encoders(packing.TOKENIZER)
    for text in ["Hello  world\n\n é ß \t 12345", "的中文 emoji 😀", "a" * 5000, " x y'll don't"]:
        assert fast.encode_ordinary(text) == slow.encode(text, add_special_tokens=False).ids


def test_fill_finds_the_closest_sum():
    rng = random.Random(7)
    for _ in range(60):
        counts = {rng.randrange(1, 60): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        used = packing.fill(counts, 64)
        largest = max(counts)
        assert used[largest] >= 1 and all(k <= counts[n] for n, k in used.items())
        reach = {largest}
        for n, c in counts.items():
            for _ in range(c - (n == largest)):
                reach |= {s + n for s in reach if s + n <= 64}
        assert sum(n * k for n, k in used.items()) == max(reach)


def test_plan_uses_all():
    histogram = {n: (n * 37) % 11 for n in range(1, 1025)}
    patterns = packing.plan(dict(histogram))
    used = {}
    for multiset, times in patterns:
        assert sum(n * k for n, k in multiset.items()) <= 1024
        for n, k in multiset.items():
            used[n] = used.get(n, 0) + k * times
    assert used == {n: c for n, c in histogram.items() if c}


def test_empty(spark):
    assert packing.pack(documents(spark, [])).count() == 0
