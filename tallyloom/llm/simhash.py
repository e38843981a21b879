"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are made in one pass over whole texts. Candidates meet by the pigeonhole rule: two
fingerprints within the radius agree in all but `radius` of a few bit blocks, so every choice of
agreeing blocks is a key. Rows of a key are compared in tiles by carry-save counters on bit planes
(see bitslice); a tile returns a spanning forest of its links, never its pairs, and components are
joined up over the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitslice import close_pairs, forest
from .common import connected_components, lookup_by_group, stage, tiles, whole_text

SEED = 42
TILE = 512
CAP = 4096


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included. Words: runs without ASCII white space, A-Z lower-cased.

    Fewer words than `width` make one shingle of the whole sequence; no words make none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, len(words) - width + 1)


def majority(hashes: np.ndarray, chunk: int = 8192) -> np.ndarray:
    """(n, words) hashes to the word vector whose bits are set in over half of the rows; zero for none."""
    n, words = hashes.shape
    count = np.zeros(words * 64, np.int64)
    for at in range(0, n, chunk):
        part = np.ascontiguousarray(hashes[at : at + chunk])
        count += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(count * 2 > n, bitorder="little").view(np.uint64)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [majority(shingle_hashes(t.as_py(), 3)[:, None])[0] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())], ["doc_id", "fp"]
        )


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fp: the 64 bits as a long. A null text counts as empty and has fingerprint zero."""
    rows = documents.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def block_keys(radius: int, agree: int = 2) -> list[tuple[int, int]]:
    """(number, mask) of every choice of `agree` of the radius + agree bit blocks."""
    blocks = radius + agree
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    return [(n, sum(masks[k] for k in c)) for n, c in enumerate(combinations(range(blocks), agree))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def compare_tiles(radius: int):
    """mapInArrow function on rows (tile, id, fp...) sorted by tile: forests of the links within each tile.

    Small tiles are compared together, up to TILE rows at a time: a pair within the radius is a link
    whichever key brought it together.
    """

    def links(ids: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")  # roots are smallest ids, so tiles that share rows agree on them
        ids, prints = ids[order], prints[order]
        i, j = close_pairs(prints, radius)
        root = forest(len(ids), i, j)
        tied = np.nonzero(root != np.arange(len(ids)))[0]
        tied = tied[ids[tied] != ids[root[tied]]]
        return pa.RecordBatch.from_arrays([pa.array(ids[tied]), pa.array(ids[root[tied]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            held.append(rows)
            n += len(rows)
            if n < TILE:
                continue
            rows = np.concatenate(held)
            cuts = np.nonzero(np.diff(rows[:, 0]))[0] + 1
            done = 0
            while True:  # take whole tiles of at least TILE rows; the last one may go on in the next batch
                k = np.searchsorted(cuts, done + TILE)
                if k >= len(cuts):
                    break
                yield links(rows[done : cuts[k], 1], rows[done : cuts[k], 2:].view(np.uint64))
                done = cuts[k]
            held, n = [rows[done:]], len(rows) - done
        if n:
            rows = np.concatenate(held)
            yield links(rows[:, 1], rows[:, 2:].view(np.uint64))

    return run


def near_links(prints: DataFrame, radius: int = 2, cap: int = CAP) -> DataFrame:
    """prints: id, fp, distinct fingerprints. Rows (a, b): forests whose components are those of all links."""
    keys = F.array(*[F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(signed(m)))) for n, m in block_keys(radius)])
    keyed = prints.where("id is not null").select("id", "fp", F.explode(keys).alias("key"))
    dealt = tiles(keyed, "key", "id", cap).select("tile", "id", "fp")
    ordered = dealt.repartition("tile").sortWithinPartitions("tile")
    return ordered.mapInArrow(compare_tiles(radius), "a long, b long")


def near_dedup(documents: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: smallest doc_id reachable over links.

    Defined cases: null and empty texts have fingerprint zero and are linked like any other; repeated
    rows link to themselves; an empty table gives no rows. A null doc_id cannot be the smallest.
    """
    rows = stage(fingerprints(documents), "prints")
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("size")), "distinct")
    joined = connected_components(near_links(distinct.select("id", "fp"), radius))
    labels = distinct.join(joined, distinct["id"] == joined["node"], "left").select(
        "fp", "size", F.coalesce("component", "id").alias("component_id")
    )
    found = lookup_by_group(rows, stage(labels, "labels"), "fp", "size")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
