"""Near duplicates by text: SimHash comparison of documents that share rare shingles, exact shingle similarity after it.

Two sets of shingles as alike as asked share one of their first few shingles in any fixed order of all
shingles (prefix filtering), so these first few are the keys by which documents meet: frequent shingles
come last in the order, the others by their hash. Documents that share a key are compared by long SimHash
fingerprints in the bit-sliced comparison, whose radius is five standard deviations beyond what the least
similarity gives. That makes coarse groups, and within these the shingle sets themselves are compared, in
tiles of bounded size. Tiles return spanning forests, so groups of any size yield no pair lists. Nothing
depends on the number of documents; the keys are exact, and the radius misses a pair of the least
similarity less than once in a million.

Defined cases: null and empty texts have no shingles and resemble nothing; a text of fewer words than a
shingle is one shingle; the smallest doc_id of a group stays; rows whose doc_id is null or repeats with
another text are documents of their own, count as smaller than all others, and stay or go by their own
text; rows that repeat both doc_id and text stay or go together; other columns are kept, but for _node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitslice import forest
from .common import connected_components, stage, tiles, whole_text
from .simhash import compare_tiles, shingle_hashes

WIDTH = 5
LEAST = 0.8
WORDS = 8
#: Of the 512 bits of two texts at similarity 0.8 a share of acos(2 * 0.8 / 1.8) / pi = 0.151 differs, or 77 and a
#: standard deviation of 8; of very short texts up to 0.19, or 97 and 9. Unrelated texts differ in 256.
RADIUS = 140
CAP = 2048
SET_CAP = 512
#: Shingles in this share of the documents or more come last in the order of keys. That is read off a sample of documents;
#: the order is for speed and any would give the same groups.
FREQUENT = 0.002
SAMPLE = 20_000
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
PRINTS = [f"p{k}" for k in range(WORDS)]


def spread(hashes: np.ndarray, words: int) -> np.ndarray:
    """(n,) hashes to (n, words) independent ones."""
    x = hashes[:, None] + np.arange(1, words + 1, dtype=np.uint64)[None, :] * ODD[0]
    x = (x ^ (x >> np.uint64(30))) * ODD[1]
    x = (x ^ (x >> np.uint64(27))) * ODD[2]
    return x ^ (x >> np.uint64(31))


def long_print(hashes: np.ndarray, words: int, chunk: int = 4096) -> np.ndarray:
    """Majority of the spread hashes; `words` 64-bit words of fingerprint."""
    count = np.zeros(words * 64, np.int64)
    for at in range(0, len(hashes), chunk):
        part = spread(hashes[at : at + chunk], words)
        count += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(count * 2 > len(hashes), bitorder="little").view(np.uint64)


def frequent_shingles(rows: DataFrame, sets=None, share: float = FREQUENT, sample: int = SAMPLE) -> np.ndarray:
    """Hashes of shingles in at least `share` of a sample of about `sample` documents, in order; at most their words / share.

    sets: mapInArrow function from (id, text) to (id, shingles); by default the shingles of near duplicates.
    """
    n = rows.count()
    some = rows if n <= sample else rows.where(F.pmod(F.xxhash64(F.lit("shingles"), "id"), F.lit(1 << 20)) < sample * (1 << 20) // n)
    found = some.select("id", "text").mapInArrow(sets or _sets, "id long, shingles array<long>")
    counted = found.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    found = counted.where(F.col("n") >= max(20, int(share * min(n, sample)))).select("s").collect()
    return np.sort(np.array([r[0] for r in found], np.int64))


def prefix(shingles: np.ndarray, frequent: np.ndarray, least: float) -> np.ndarray:
    """The first of a sorted set of hashes, so many that two sets alike by `least` must share one: frequent ones come last."""
    n = len(shingles)
    keep = n - int(np.ceil(n * least - 1e-9)) + 1
    if not len(frequent):
        return shingles[:keep]
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    last = frequent[at] == shingles
    return np.concatenate((shingles[~last], shingles[last]))[:keep]


def _keys(frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints, keys = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes = np.unique(shingle_hashes(text.as_py(), WIDTH))
                if len(hashes):
                    ids.append(doc_id)
                    prints.append(long_print(hashes, WORDS).view(np.int64))
                    keys.append(prefix(np.sort(hashes.view(np.int64)), frequent, LEAST))
            table = np.array(prints, np.int64).reshape(-1, WORDS)
            columns = [pa.array(ids, pa.int64()), pa.array(keys, pa.list_(pa.int64())), *[pa.array(table[:, k]) for k in range(WORDS)]]
            yield pa.RecordBatch.from_arrays(columns, ["id", "keys", *PRINTS])

    return run


def coarse_links(rows: DataFrame) -> DataFrame:
    """rows: id, text. Forests (a, b) of documents that share a key and whose fingerprints are within the radius."""
    schema = "id long, keys array<long>, " + ", ".join(f"{p} long" for p in PRINTS)
    made = stage(rows.mapInArrow(_keys(frequent_shingles(rows)), schema), "prints")
    keyed = made.select("id", F.explode("keys").alias("key"))
    counted = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("who"), F.min("id").alias("low"))
    # of keys with the same members one is enough
    shared = stage(counted.where("n > 1").groupBy("who", "n", "low").agg(F.min("key").alias("key")).select("key"), "shared")
    met = stage(keyed.join(shared, "key"), "met")
    dealt = tiles(met, "key", "id", CAP).select("tile", "id").join(made.drop("keys"), "id").select("tile", "id", *PRINTS)
    return dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(compare_tiles(RADIUS), "a long, b long")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(shingle_hashes(t.as_py(), WIDTH)).view(np.int64) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])


def similar(sets: list[np.ndarray], least: float) -> np.ndarray:
    """For each set the first one tied to it by pairs of at least that Jaccard similarity. Exact.

    An inverted index counts common shingles; sets tied already are not compared again.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    root = np.arange(m)
    shingle = np.concatenate(sets)
    order = np.argsort(shingle, kind="stable")
    shingle = shingle[order]
    first = np.concatenate(([True], shingle[1:] != shingle[:-1]))
    begin = np.append(np.nonzero(first)[0], len(shingle))
    del shingle  # the sets of a tile may be long: no array of their length is kept that is not needed below
    owner = np.repeat(np.arange(m, dtype=np.int32), sizes)[order]
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(first) - 1
    del order, first
    at = np.concatenate(([0], np.cumsum(sizes)))
    for i in range(m):
        mine = back[at[i] : at[i + 1]]
        lows, highs = begin[mine], begin[mine + 1]
        shared = highs - lows > 1
        if not shared.any():
            continue
        lows, lengths = lows[shared], highs[shared] - lows[shared]
        place = np.repeat(lows - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        common = np.bincount(owner[place], minlength=m)
        alike = np.nonzero(common >= least * (sizes + sizes[i] - common) - 1e-9)[0]
        low = root[alike].min() if len(alike) else root[i]
        old = np.unique(root[alike])
        if len(old) > 1:
            root[np.isin(root, old)] = low
    return root


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tile, id, shingles) by tile: forests of the exact links within each tile."""
    now, ids, sets = None, [], []

    def links() -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=ids.__getitem__)
        ids[:], sets[:] = [ids[k] for k in order], [sets[k] for k in order]
        root = similar(sets, LEAST)
        tied = [k for k in range(len(ids)) if root[k] != k and ids[k] != ids[root[k]]]
        pairs = [ids[k] for k in tied], [ids[root[k]] for k in tied]
        return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()) for p in pairs], ["a", "b"])

    for batch in batches:
        tile, doc_id, shingles = batch.columns
        for k in range(len(batch)):
            if tile[k].as_py() != now:
                if len(ids) > 1:
                    yield links()
                now, ids, sets = tile[k].as_py(), [], []
            ids.append(doc_id[k].as_py())
            sets.append(shingles[k].values.to_numpy(zero_copy_only=False))
    if len(ids) > 1:
        yield links()


def with_nodes(documents: DataFrame) -> DataFrame:
    """The documents with _node: the doc_id where it stands for one text, else a number below all doc_ids for each of its texts."""
    own = F.col("doc_id").cast("long")
    counts = documents.groupBy(own.alias("_id")).agg(F.count("*").alias("_n"))
    odd = stage(counts.where("_n > 1 or _id is null").select("_id"), "odd")
    rows = documents.drop("_node")
    if not odd.take(1):
        return rows.withColumn("_node", own)
    digest = F.sha2(whole_text(), 256)
    low = documents.agg(F.least(F.coalesce(F.min(own), F.lit(0)), F.lit(0))).first()[0]
    texts = documents.select(own.alias("_i"), digest.alias("_s"))
    texts = stage(texts.join(odd, texts["_i"].eqNullSafe(odd["_id"])).select("_i", "_s").distinct(), "texts")
    many = texts.groupBy("_i").agg(F.count("*").alias("_n")).where("_n > 1 or _i is null").select(F.col("_i").alias("_id"))
    numbered = texts.join(many, texts["_i"].eqNullSafe(many["_id"])).select("_i", "_s")
    numbered = stage(numbered.withColumn("_n", F.lit(low - 1) - F.monotonically_increasing_id()), "numbered")
    joined = rows.join(numbered, own.eqNullSafe(numbered["_i"]) & (digest == numbered["_s"]), "left")
    return joined.select(*[rows[c] for c in rows.columns], F.coalesce(numbered["_n"], own).alias("_node"))


def near_groups(rows: DataFrame) -> DataFrame:
    """rows: id, text. (node, component) of the documents in groups of two or more; component is the smallest id."""
    coarse = stage(connected_components(coarse_links(rows)).withColumnRenamed("node", "id"), "coarse")
    sets = stage(rows.join(coarse, "id").select("id", "text").mapInArrow(_sets, "id long, shingles array<long>"), "sets")
    dealt = tiles(coarse, "component", "id", SET_CAP).join(sets.dropDuplicates(["id"]), "id").select("tile", "id", "shingles")
    exact = dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(_exact, "a long, b long")
    return connected_components(exact)


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """The documents without those that resemble one of a smaller doc_id in their group."""
    rows = with_nodes(documents)
    texts = rows.select(F.col("_node").alias("id"), whole_text().alias("text"))
    dropped = stage(near_groups(texts).where("node <> component").select(F.col("node").alias("_node")), "dropped")
    return rows.join(dropped, "_node", "left_anti").drop("_node")
