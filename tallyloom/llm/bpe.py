"""Byte-level BPE encoding by corpus-level merge replay, and decoding.

Texts are split by the tokenizer's pattern, and words are encoded rather than texts: a word has the same ids
wherever it stands. The words of the whole corpus are counted, combined in their tasks before the shuffle, and dealt
by hash. Every deal replays the merges on all its words at once: an inverted index holds, for each token that a pair
of neighbours spells, the positions of such pairs; its ranks are taken in rising order, all positions of a rank
are merged from left to right, and only the two pairs at the merged token's sides are looked up anew. A rank that
turns up late, below the one being replayed, has its word encoded alone, so the ids are those of encoding each word
by itself, whatever the table of ranks.

The most frequent words (at most FREQUENT, of at most LONGEST code points; the least count is read off a histogram)
go to every task as one table of bounded size. The words beyond it are replayed, by the same index, for each block of
documents; what a task remembers of them is bounded. Texts are never shuffled.

Defined cases: a null text counts as empty and has no ids; repeated rows and null ids are rows of their own; no
string is special; a text of any length is read to its end, and a word of any length is one word; an empty table
gives no rows; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage, unstage, whole_text

RANKS = "byte_bpe_50k.tiktoken"
FREQUENT = 200_000
LONGEST = 32
COUNTED = 300_000  # words that a task counts before it hands them on
REMEMBERED = 150_000  # words beyond the table that a task remembers
BLOCK = 1 << 23  # code points split at a time
DEAL = 150_000  # words replayed at a time
ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)


def packed(ids: Iterable[int]) -> bytes:
    return np.fromiter(ids, "<i4").tobytes()


class Vocabulary:
    """Tokens by rank, ranks by token, and the ranks that pairs of tokens spell, by first * size + second."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.whole = {t: packed([i]) for t, i in ranks.items()}
        self.size = max(ranks.values()) + 1
        self.single = np.array([ranks[bytes([b])] for b in range(256)])
        splits = ((r, ranks.get(t[:k]), ranks.get(t[k:])) for t, r in ranks.items() for k in range(1, len(t)))
        self.spelled = {a * self.size + b: r for r, a, b in splits if a is not None and b is not None}
        self._keys = np.array(sorted(self.spelled) + [1 << 62], np.int64)
        self._ranks = np.array([self.spelled[k] for k in self._keys[:-1].tolist()] + [-1], np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank that each pair of tokens spells, -1 where it is no token."""
        key = a * self.size + b
        at = np.searchsorted(self._keys, key)
        return np.where(self._keys[at] == key, self._ranks[at], -1)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def vocabulary(name: str = RANKS) -> Vocabulary:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)})


@lru_cache(maxsize=1)
def disputed() -> dict[int, str]:
    """Code points that the two regex libraries class apart, with a character of the class that tiktoken sees.

    Tables of Unicode differ by version. tiktoken is asked whether a, 1 and ! end a word before each code point, by a
    vocabulary that joins these three to any byte.
    """
    import public_tokenizers
    import regex
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {bytes([p, b]): 256 * k + b for k, p in enumerate(b"a1!", 1) for b in range(256)}
    probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    kinds = {"a": regex.compile(r"\p{L}"), "1": regex.compile(r"\p{N}"), "!": regex.compile(r"[^\s\p{L}\p{N}]")}
    points = [chr(c) for c in range(128, 0x40000) if not 0xD800 <= c < 0xE000]  # the planes above hold no letters or numbers
    found = {}
    for kind, pattern in kinds.items():
        ids = np.array(probe.encode_ordinary("\n".join(kind + c for c in points)))
        joined = ids[(ids == ord(kind)) | (ids >= 256)] >= 256
        own = set(pattern.findall("".join(points)))
        found |= {ord(points[k]): kind for k in np.flatnonzero(joined) if points[k] not in own}
    return found


def splitter(apart: dict[int, str]) -> Callable[[str], list[str]]:
    """A function that gives the matches of the pattern in a text, which together are the text. apart: see disputed()."""
    import public_tokenizers
    import regex

    whole = regex.compile(public_tokenizers.PATTERN)
    strange = frozenset(map(chr, apart))

    def split(text: str) -> list[str]:
        if text.isascii():
            return ASCII.findall(text)
        if strange.isdisjoint(text):
            return whole.findall(text)
        return [text[m.start() : m.end()] for m in whole.finditer(text.translate(apart))]

    return split


def alone(word: bytes, known: Vocabulary) -> list[int]:
    """The ids of one word by its own merges: always the least rank, and of its places the leftmost."""
    tokens = [int(t) for t in known.single[np.frombuffer(word, np.uint8)]]
    after, before = [*range(1, len(word)), -1], [*range(-1, len(word) - 1)]
    spelled, size = known.spelled, known.size
    heap = [(spelled[key], p) for p in range(len(word) - 1) if (key := tokens[p] * size + tokens[p + 1]) in spelled]
    heapify(heap)
    while heap:
        r, p = heappop(heap)
        q = after[p]
        if q < 0 or tokens[p] < 0 or spelled.get(tokens[p] * size + tokens[q]) != r:
            continue
        tokens[p], tokens[q], after[p] = r, -1, after[q]
        if after[q] >= 0:
            before[after[q]] = p
        for left in (before[p], p):
            if left >= 0 and after[left] >= 0 and (key := tokens[left] * size + tokens[after[left]]) in spelled:
                heappush(heap, (spelled[key], left))
    return [t for t in tokens if t >= 0]


def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of rising positions those that merge, from left to right, where one pair begins with the other's end."""
    used, kept = -1, []
    for p, q in zip(at.tolist(), after[at].tolist()):
        if p != used:
            kept.append(p)
            used = q
    return np.array(kept, np.int64)


def replay(words: list[bytes], known: Vocabulary) -> list[bytes]:
    """The ids of each word as 32-bit integers, all merges of a rank applied in all words before those of the next."""
    out = [known.whole.get(w, b"") for w in words]
    long = [k for k, w in enumerate(words) if w and not out[k]]
    if not long:
        return out
    tokens = known.single[np.frombuffer(b"".join(words[k] for k in long), np.uint8)]
    n = len(tokens)
    ends = np.cumsum([len(words[k]) for k in long])
    starts = np.concatenate([[0], ends[:-1]])
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends - 1], before[starts] = -1, -1
    left = np.flatnonzero(after >= 0)
    rank = known.rank(tokens[left], tokens[left + 1])
    order = np.argsort(rank, kind="stable")
    order = order[np.searchsorted(rank[order], 0) :]
    present, first = np.unique(rank[order], return_index=True)
    places: dict[int, list] = {r: [at] for r, at in zip(present.tolist(), np.split(left[order], first[1:]))}
    ranks = list(places)
    heapify(ranks)
    odd: set[int] = set()
    while ranks:
        r = heappop(ranks)
        found = places.pop(r)
        at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        nexts = after[at]
        here = (tokens[at] >= 0) & (nexts >= 0)
        at, nexts = at[here], nexts[here]
        here = known.rank(tokens[at], tokens[nexts]) == r
        at, nexts = at[here], nexts[here]
        if not len(at):
            continue
        if len(at) > 1 and (nexts[:-1] == at[1:]).any():
            at = _apart(at, after)
            nexts = after[at]
        rights = after[nexts]
        beside = at[1:][rights[:-1] == at[1:]]  # merge in this step, but after the merge to their left
        early = known.rank(np.full(len(beside), r), tokens[beside])
        odd.update((np.searchsorted(starts, beside[(early >= 0) & (early < r)], "right") - 1).tolist())
        tokens[at], tokens[nexts] = r, -1
        after[at] = rights
        more = rights >= 0
        before[rights[more]] = at[more]
        lefts = before[at]
        touched = np.concatenate([at[more], lefts[lefts >= 0]])  # the pairs at the merged token's sides
        new = known.rank(tokens[touched], tokens[after[touched]])
        if (new < r).any():
            late = touched[(new >= 0) & (new < r)]
            odd.update((np.searchsorted(starts, late, "right") - 1).tolist())
            touched, new = touched[new > r], new[new > r]
        if len(new) > 1:
            order = np.argsort(new, kind="stable")
            new, touched = new[order], touched[order]
            cut = np.flatnonzero(new[1:] != new[:-1]) + 1
            parts = zip(new[np.concatenate([[0], cut])].tolist(), np.split(touched, cut))
        else:
            parts = zip(new.tolist(), [touched])
        for s, p in parts:
            if s in places:
                places[s].append(p)
            else:
                places[s] = [p]
                heappush(ranks, s)
    alive = tokens >= 0
    ids = tokens[alive].astype("<i4").tobytes()
    begin = 0
    for k, end in zip(long, (4 * np.cumsum(alive)[ends - 1]).tolist()):
        out[k], begin = ids[begin:end], end
    for k in odd:
        out[long[k]] = packed(alone(words[long[k]], known))
    return out


def replayed(words: list[str], known: Vocabulary, deal: int = DEAL) -> Iterator[bytes]:
    for at in range(0, len(words), deal):
        yield from replay([w.encode() for w in words[at : at + deal]], known)


def blocks(batches: Iterator[pa.RecordBatch], split: Callable[[str], list[str]], size: int = BLOCK) -> Iterator[tuple[list, list[list[str]]]]:
    """Row keys (first column) and split texts (second), about `size` code points at a time."""
    keys, found, held = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            keys.append(key)
            found.append(split(text))
            held += len(text)
            if held >= size:
                yield keys, found
                keys, found, held = [], [], 0
    if keys:
        yield keys, found


def _counted(apart):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def taken() -> pa.RecordBatch:
            kept = [(w, n) for w, n in counts.items() if len(w) <= LONGEST]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for _, found in blocks(batches, splitter(apart.value)):
            counts.update(chain.from_iterable(found))
            if len(counts) > COUNTED:
                yield taken()
        yield taken()

    return run


def _replayed(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = list(replayed(batch.column(0).to_pylist(), vocabulary(name)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["word", "ids"])

    return run


def frequent_words(documents: DataFrame, ranks: str = RANKS, most: int = FREQUENT) -> DataFrame:
    """word, ids (packed): the words of the corpus that occur oftenest, at most `most`, encoded by replay in many tasks."""
    texts = documents.select(F.lit(0).alias("k"), whole_text().alias("t"))
    apart = documents.sparkSession.sparkContext.broadcast(disputed())
    counts = stage(texts.mapInArrow(_counted(apart), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    step = F.floor(8 * F.log2("n")).cast("int")
    least, total = 0, 0
    for r in sorted(counts.groupBy(step.alias("s")).count().collect(), reverse=True):  # some 500 rows at most
        total += r[1]
        if total > most:
            least = r[0] + 1
            break
    table = stage(counts.where(step >= least).select("word").repartition("word").mapInArrow(_replayed(ranks), "word string, ids binary"), "encoded")
    unstage(counts)
    return table


def encode(documents: DataFrame, ranks: str = RANKS, most: int = FREQUENT, back: bool = False) -> DataFrame:
    """doc_id, ids: one row a document. back: also the bytes that the ids spell, `decoded`, by the same workers."""
    table = frequent_words(documents, ranks, most)
    shared = documents.sparkSession.sparkContext.broadcast({r.word: bytes(r.ids) for r in table.collect()})  # at most `most` rows
    apart = documents.sparkSession.sparkContext.broadcast(disputed())
    unstage(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, known = shared.value, vocabulary(ranks)
        ids_of = common.copy()
        for keys, found in blocks(batches, splitter(apart.value)):
            if len(ids_of) > REMEMBERED + len(common):
                ids_of = common.copy()
            new = list(set(chain.from_iterable(found)).difference(ids_of))
            ids_of.update(zip(new, replayed(new, known)))
            rows = [b"".join(map(ids_of.__getitem__, words)) for words in found]
            for w in new:
                if len(w) > LONGEST:
                    del ids_of[w]
            ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), "<i4")))
            columns = [pa.array(keys, pa.int64()), ids] + ([spelled(ids, known)] if back else [])
            yield pa.RecordBatch.from_arrays(columns, [f.split(" ")[0] for f in fields.split(", ")])

    fields = "doc_id long, ids array<int>" + ", decoded binary" * back
    return documents.select(F.col("doc_id").cast("long"), whole_text().alias("_text")).mapInArrow(run, fields)


def spelled(lists: pa.ListArray, known: Vocabulary) -> pa.Array:
    """The bytes of each list of ids."""
    ends = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
    flat = lists.flatten().to_numpy().tolist()  # one step for all rows: nested lists are slow to make
    return pa.array([known.decode(flat[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())


def decoded(ids: Column, ranks: str = RANKS) -> Column:
    """The bytes that a column of ids spells; null where the ids are."""

    @F.arrow_udf(T.BinaryType())
    def run(lists: pa.Array) -> pa.Array:
        return spelled(lists, vocabulary(ranks))

    return F.when(ids.isNotNull(), run(F.coalesce(ids, F.array().cast("array<int>"))))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row per document."""
    rows = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), back=True)
    listed = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
