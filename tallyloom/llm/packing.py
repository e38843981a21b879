"""Packing token sequences by minimum bin slack.

Every document is tokenized once and cut into full windows and one remainder, so lengths are at most
the window. Only the length histogram (at most `window` rows, whatever the corpus) is planned on the
driver: a bitset subset-sum over the remaining multiset picks the companions that bring the largest
remaining length closest to the window, the counts are read off by backtracking, and the pattern is
used as often as the histogram allows. Pieces find their place by rank within their length, counted in
salts of a bounded number of pieces, as most pieces of a large corpus have the length of the window.

Defined cases: null and empty texts are the single id 0; repeated rows are packed each for itself;
an empty table gives no rows; a long text is cut into as many windows as it needs.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, whole_text

WINDOW = 1024
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
PER_SALT = 50_000  # pieces that one sort of a length holds, about
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@lru_cache(maxsize=2)
def _encoders(name: str):
    """The tokenizer and, for speed, its vocabulary in tiktoken, which yields the same ids several times faster.

    Texts that spell a special token go to the tokenizer itself, which alone treats them specially.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(name))
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return slow, fast, special


def token_ids(text: str, tokenizer: str = TOKENIZER) -> np.ndarray:
    slow, fast, special = _encoders(tokenizer)
    if any(s in text for s in special):
        ids = slow.encode(text, add_special_tokens=False).ids
    else:
        ids = fast.encode_ordinary(text)
    out = np.empty(len(ids) + 1, "<u4")
    out[:-1], out[-1] = ids, END_ID
    return out


def _pieces(window: int, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = token_ids(text.as_py(), tokenizer)
                for at in range(0, len(ids), window):
                    part = ids[at : at + window]
                    out.append((doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return run


def cut(documents: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER) -> DataFrame:
    rows = documents.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return rows.mapInArrow(_pieces(window, tokenizer), PIECES)


def fill(counts: dict[int, int], window: int) -> dict[int, int]:
    """The multiset of remaining lengths, its largest among them, whose sum is closest to the window from below."""
    largest = max(counts)
    target = window - largest
    left = {n: c - (n == largest) for n, c in counts.items()}
    reach, steps = 1, []  # bit s of reach: some multiset seen so far sums to s
    keep = (1 << (target + 1)) - 1
    for n in sorted(left, reverse=True):
        most, size = min(left[n], target // n if n else 0), 1
        while most > 0 and not reach >> target & 1:
            k = min(size, most)
            steps.append((n, k, reach))
            reach |= reach << n * k & keep
            most, size = most - k, size * 2
    total = reach.bit_length() - 1
    used = {largest: 1}
    for n, k, before in reversed(steps):
        if not before >> total & 1:
            used[n] = used.get(n, 0) + k
            total -= n * k
    return used


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """(multiset, repetitions) until no length is left. Its size depends on the window, not on the counts."""
    counts, patterns = {n: c for n, c in histogram.items() if c}, []
    while counts:
        used = fill(counts, window)
        times = min(counts[n] // k for n, k in used.items())
        patterns.append((used, times))
        for n, k in used.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
    return patterns


def _places(patterns: list[tuple[dict[int, int], int]]) -> list[tuple]:
    """(length, first rank, end rank, copies a sequence, first sequence, offset) for each use of a length."""
    rows, seen, sequence = [], {}, 0
    for used, times in patterns:
        offset = 0
        for n, k in sorted(used.items(), reverse=True):
            low = seen.get(n, 0)
            seen[n] = low + k * times
            rows.append((n, low, seen[n], k, sequence, offset))
            offset += n * k
        sequence += times
    return rows


def pack(documents: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = documents.sparkSession
    pieces = stage(cut(documents, window, tokenizer), "pieces")
    salts = pieces.count() // PER_SALT + 1
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    counts = stage(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")), "lengths")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # at most `window` rows
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("_row", F.row_number().over(own)).join(base, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_row") - 1)
    fields = "length long, _low long, _end long, _copies long, _first long, _offset long"
    places = spark.createDataFrame(_places(plan(histogram, window)), fields)
    used = F.col("_rank") - F.col("_low")
    placed = ranked.join(F.broadcast(places), "length").where("_rank >= _low and _rank < _end")
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("_first") + F.floor(used / F.col("_copies"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + used % F.col("_copies") * F.col("length")).cast("long").alias("offset"),
    )


def min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
