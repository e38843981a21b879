"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

At each anchor the next few content words form a chain; a text's fingerprint is the set of 64-bit hashes of
its (anchor, chain) pairs. Likeness is the Jaccard measure of two sets. Near-duplicate search partitions the
sets by length, since sets of too different length cannot be alike; sets of a partition and the next one meet
by their first signatures in a fixed order (prefix filtering), and are compared by pruned Jaccard: only within
the lengths that can be alike, and only with sets that share one of those first signatures. Links come back as
forests, so groups of any size yield no pairs.

Defined cases: a null text counts as empty; a text without a full chain has one signature of its whole
word sequence, or none if it has no words; two empty sets are alike (1.0), an empty and another not
(0.0), and sets without signatures are in no class with others; equal texts have equal fingerprints; repeated
doc_ids follow each other in the order of their texts and share the smallest of their classes; a null doc_id has
no class; the only document is its own next. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, lookup_by_group, stage, tiles, unstage, whole_text
from .near_text import frequent_shingles, prefix

CHAIN = 3
LEAST = 0.8
CAP = 1024
RANGE_BYTES = 128 << 20
WORD = re.compile(r"\w+")
#: Anchors (first line of each language) and further common words, none of which can be part of a chain.
ANCHORS = frozenset(
    "the a an of and to in is it that was are be for"
    " der die das und ein eine ist von zu"
    " le la les de des un une et est que"
    " el los las del una y es por se".split()
)
COMMON = ANCHORS | frozenset(
    "with on as by this from at or not but have had he she they we you i his her its which"
    " den dem im mit auf sich nicht auch als"
    " du en au aux dans pour par sur avec qui elle il pas"
    " con para como su al lo no más".split()
)


def signatures(text: str, chain: int = CHAIN) -> frozenset[int]:
    content: list[str] = []
    spots: list[tuple[str, int]] = []
    common, anchors = COMMON, ANCHORS
    for word in WORD.findall(text.lower()):
        if word in common:
            if word in anchors:
                spots.append((word, len(content)))
        else:
            content.append(word)
    full = len(content) - chain
    digest = xxhash.xxh64_intdigest
    found = frozenset([digest(" ".join([a, *content[k : k + chain]])) for a, k in spots if k <= full])
    if found:
        return found
    words = WORD.findall(text.lower()) or text.split()
    return frozenset([digest("\n" + " ".join(words))]) if words else found


def likeness(a: frozenset[int], b: frozenset[int], least: float = 0.0) -> float:
    """Jaccard measure; 0.0 without counting where the lengths alone rule out `least`."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not large:
        return 1.0
    if len(small) < least * len(large):
        return 0.0
    both = len(small & large)
    return both / (len(small) + len(large) - both)


def fingerprint(found: frozenset[int]) -> str:
    """The signatures in order, sixteen hex digits each."""
    return "".join(["%016x" % s for s in sorted(found)])


def next_ranges(documents: DataFrame, ranges: int) -> tuple[list[int], dict[int, list[int]]]:
    """Split points of doc_id, and for each range's largest doc_id the ranges that need it as a next document.

    Everything here has at most `ranges` entries, a number set by the cluster.
    """
    ids = documents.select(F.col("doc_id").cast("long").alias("id")).where("id is not null")
    cuts = sorted({int(c) for c in ids.approxQuantile("id", [k / ranges for k in range(1, ranges)], 0.2 / ranges)}) if ranges > 1 else []
    tops = ids.groupBy(_range(F.col("id"), cuts).alias("r")).agg(F.max("id").alias("top")).collect()
    order = sorted(((r[0], r[1]) for r in tops), reverse=True)  # ranges in descending doc_id
    wanted: dict[int, list[int]] = {}
    for k, (r, _) in enumerate(order):
        after = order[(k + 1) % len(order)]
        wanted.setdefault(after[1], []).append(r)
    return cuts, wanted


def _range(column: Column, cuts: list[int]) -> Column:
    """Number of split points below the id, by way of blocks of them; null ids go to range 0, below all others."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts)) + 1
    blocks = [cuts[k : k + width] for k in range(0, len(cuts), width)]
    longs = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")
    block = F.size(F.filter(longs([b[0] for b in blocks]), lambda c: c < column))
    inside = F.split(F.get(F.split(F.lit(";".join(",".join(map(str, b)) for b in blocks)), ";"), block - 1), ",").cast("array<long>")
    below = (block - 1) * width + F.size(F.filter(inside, lambda c: c < column))
    return F.when(column.isNull() | (block == 0), 0).otherwise(below)


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double, class_id long"
)
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
FLUSH = 256
CLASS, OWN, FOREIGN = 0, 1, 2  # kinds of rows dealt to a range


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, as they are shuffled."""
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [packer.compress(t.as_py().encode("utf-8", "surrogatepass")) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "packed"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, kind, doc_id, packed, class) by range: own rows in descending doc_id, each after the row of its class, then the foreign next document."""
    out: list[tuple] = []
    last = None  # range, doc_id, text, signatures, class of the row that waits for its next document
    label = None  # range, doc_id and class of the last class row
    unpacker = zstandard.ZstdDecompressor()

    def emit() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], NAMES)
        out.clear()
        return batch

    for batch in batches:
        r, kind, ids, packed, classes = batch.columns
        for k in range(len(batch)):
            at, what, doc_id = r[k].as_py(), kind[k].as_py(), ids[k].as_py()
            if what == CLASS:
                label = (at, doc_id, classes[k].as_py())
                continue
            text = unpacker.decompress(packed[k].as_py()).decode("utf-8", "surrogatepass")
            mine = signatures(text)
            if last is not None and last[0] == at:
                _, before, whole, own, group = last
                half = len(whole) // 2
                edited = whole[: len(whole) - half] + text[:half]
                changed = signatures(edited)
                digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((before, len(whole), digest, fingerprint(own), fingerprint(changed), likeness(own, changed), likeness(own, mine), group))
                if len(out) >= FLUSH:
                    yield emit()
            group = label[2] if label is not None and label[:2] == (at, doc_id) else None
            last = None if what == FOREIGN else (at, doc_id, text, mine, group)
    if out:
        yield emit()


def edited_fingerprints(documents: DataFrame, ranges: int | None = None, classes: DataFrame | None = None) -> DataFrame:
    """Every document against its text edited with the next one's beginning, and against the next one.

    Documents are dealt by ranges of doc_id, so that neighbours meet in one task; the first document of a range also
    goes, marked, to the range before it. classes: from near_classes, to have class_id too (else null); its rows go to the
    ranges as rows of their own, so texts are shuffled once.
    """
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = documents.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0] if ranges is None else 0
    cuts, wanted = next_ranges(documents, ranges or max(2 * parts, size // RANGE_BYTES))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(_packed, "doc_id long, packed binary")
    own = F.struct(_range(F.col("doc_id"), cuts).alias("r"), F.lit(OWN).alias("kind"))
    needs = spark.createDataFrame(list(wanted.items()), "doc_id long, extra array<int>")  # at most `ranges` rows
    copies = F.transform(F.coalesce("extra", F.array().cast("array<int>")), lambda n: F.struct(n.alias("r"), F.lit(FOREIGN).alias("kind")))
    joined = rows.join(F.broadcast(needs), "doc_id", "left")
    none = lambda kind: F.lit(None).cast(kind)
    dealt = joined.select(F.explode(F.concat(F.array(own), copies)).alias("to"), "doc_id", "packed").select("to.r", "to.kind", "doc_id", "packed", none("long").alias("class_id"))
    if classes is not None:
        dealt = dealt.unionByName(classes.select(_range(F.col("doc_id"), cuts).alias("r"), F.lit(CLASS).alias("kind"), "doc_id", none("binary").alias("packed"), "class_id"))
    order = ["r", F.col("kind") == FOREIGN, F.col("doc_id").desc_nulls_last(), "kind", "packed"]
    return dealt.repartition("r").sortWithinPartitions(*order).mapInArrow(_compare, SCHEMA)


def spotsigs_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("class_id")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.array(sorted(signatures(t.as_py())), np.uint64).view(np.int64) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "shingles"])


def _key_rows(frequent: np.ndarray, least: float):
    """Each set's size, a hash of the whole, and its first signatures in the order of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.sort(np.array(list(signatures(t.as_py())), np.uint64).view(np.int64)) for t in batch.column(1)]
            prints = pa.array([hashlib.sha256(f.tobytes()).digest()[:16] for f in found], pa.binary())
            keys = pa.array([prefix(f, frequent, least) for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), prints, pa.array(map(len, found), pa.int32()), keys], ["id", "print", "n", "keys"])

    return run


def pruned_links(sets: list[np.ndarray], least: float) -> list[int]:
    """For each of sets sorted by length the first one tied to it by likeness of `least` or more.

    A set meets those before it that are long enough and share one of its first signatures in the order of
    the hashes, through an index of signatures; sets already tied are not compared again.
    """
    root = list(range(len(sets)))
    sizes = [len(s) for s in sets]
    index: dict[int, list[int]] = {}
    whole = [frozenset(s.tolist()) for s in sets]
    none = np.zeros(0, np.int64)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, own in enumerate(sets):
        low = bisect_left(sizes, math.ceil(sizes[i] * least - 1e-9))
        met: set[int] = set()
        for signature in prefix(np.sort(own), none, least).tolist():
            posted = index.setdefault(signature, [])
            met.update(posted[bisect_left(posted, low) :])
            posted.append(i)
        for j in sorted(met):
            a, b = top(i), top(j)
            if a != b:
                both = len(whole[i] & whole[j])
                if both >= least * (sizes[i] + sizes[j] - both) - 1e-9:
                    root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(sets))]


def _tied(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, seen = None, [], set()

        def links() -> pa.RecordBatch:
            held.sort(key=lambda h: (len(h[1]), h[0]))
            root = pruned_links([h[1] for h in held], least)
            pairs = [(held[k][0], held[r][0]) for k, r in enumerate(root) if held[k][0] != held[r][0]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*pairs) if pairs else ((), ()))], ["a", "b"])

        for batch in batches:
            tile, doc_id, sigs = batch.columns
            for k in range(len(batch)):
                if tile[k].as_py() != now:
                    if len(held) > 1:
                        yield links()
                    now, held, seen = tile[k].as_py(), [], set()
                own = (doc_id[k].as_py(), sigs[k].values.to_numpy(zero_copy_only=False))
                same = (own[0], hash(own[1].tobytes()))
                if same not in seen:  # a repeated row
                    seen.add(same)
                    held.append(own)
        if len(held) > 1:
            yield links()

    return run


def near_classes(documents: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, class_id) of the documents that have an id: the smallest doc_id reachable over likenesses of `least` or more. Exact.

    Of equal sets one is compared. Partitions by length are a factor 1 / least wide, so alike sets are in the same
    or in adjoining ones: each set is in its own partition and visits the next.
    """
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), whole_text().alias("text"))
    schema = "id long, print binary, n int, keys array<long>"
    slim = rows.mapInArrow(_key_rows(frequent_shingles(rows, _sets), least), schema).withColumn("row", F.monotonically_increasing_id())
    made = stage(slim, "keys")
    equal = made.groupBy("print").agg(F.min("id").alias("low"), F.min_by("row", "id").alias("row"), F.count("*").alias("size"))
    equal = stage(equal, "equal")
    part = F.floor(F.log(F.col("n").cast("double")) / -math.log(least) + 1e-9)
    each = made.where("n > 0").select("row", part.alias("p"), F.explode("keys").alias("sig")).select("row", F.explode(F.array("p", F.col("p") + 1)).alias("part"), "sig")
    keyed = each.select("row", F.xxhash64("sig", "part").alias("key")).join(equal.select("row", F.col("low").alias("id")), "row").select("id", "key")
    counted = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("who"), F.min("id").alias("low"))
    # of keys with the same members one is enough
    shared = stage(counted.where("n > 1").groupBy("who", "n", "low").agg(F.min("key").alias("key")).select("key"), "shared")
    met = stage(keyed.join(shared, "key"), "met")
    sets = rows.mapInArrow(_sets, "id long, sigs array<long>")
    dealt = tiles(met, "key", "id", CAP).select("tile", "id").join(sets, "id").select("tile", "id", "sigs")
    found = connected_components(dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tied(least), "a long, b long"))
    labels = equal.join(found, equal["low"] == found["node"], "left").select("print", "size", F.coalesce("component", "low").alias("class_id"))
    out = lookup_by_group(made.select("id", "print"), stage(labels, "labels"), "print", "size")
    classes = stage(out.groupBy(F.col("id").alias("doc_id")).agg(F.min("class_id").alias("class_id")), "classes")
    for table in (made, equal, shared, met):
        unstage(table)
    return classes
