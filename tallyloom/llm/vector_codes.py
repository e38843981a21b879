"""Vector codes: product quantisation trained by exact exponion search.

Components are integers, floor(1024 * x), so distances, sums and ties are exact. A vector is cut into equal parts and
each part position has a codebook of at most 256 entries. In each round every part looks for its nearest entry from
the entry it had before: at squared distance u from that one, no nearer or equally near entry lies outside the ball of
radius 2 * sqrt(u) about it, so only the head of that entry's list of neighbours, sorted by distance, is scanned, up to
squared distance 4 * u inclusive. Of equal distances the lower index wins.

Vectors stay in their partitions. Each round writes them with their codes (the round before is deleted then), and
sends one row of sums for each task and used entry; the codebooks, at most 4 * 256 entries, are all that the driver sees.

Defined cases: a null vector, and one that holds a null or non-finite component, gives no row; a null vec_id is a row
and comes last in the choice of first entries; rows that repeat a vec_id are rows of their own, in the order of their
components there; null labels are one group; components are held to +-2**27 after scaling, where the sums fit a long;
vectors shorter than the longest count as zero beyond their end, as do components that fill it up to a multiple of
`parts`; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup_by_group, stage, unstage

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LARGEST = 1 << 27
EXACT = 1 << 52  # below it, sums of doubles are exact integers
CHUNK = 1 << 20  # distances held at a time
CODED = "vec_id long, label string, vector array<int>, codes binary, error long"


def integer_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, label, vector: the usable vectors as integers. label: null stands apart from any text."""
    x = F.col(column)
    ok = x.isNotNull() & ~F.coalesce(F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
    whole = lambda v: F.greatest(F.least(F.floor(v.cast("double") * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int")
    return rows.where(ok).select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.transform(x, whole).alias("vector"))


class Codebook:
    """The entries of one part position, with each entry's neighbours by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        between = squares(entries, entries)
        self.order = np.argsort(between, axis=1, kind="stable")  # of equal distances the lower index first
        self.far = np.take_along_axis(between, self.order, axis=1)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, exact."""
    most = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if 4 * a.shape[1] * int(most) ** 2 < EXACT:
        a, b = a.astype(np.float64), b.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        d = a[:, k][:, None] - b[:, k][None, :]
        out += d * d
    return out


def nearest(points: np.ndarray, book: Codebook, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each point's nearest entry, searched from its entry in `start`."""
    found = start.copy()
    from_start = points - book.entries[start]
    least = (from_start * from_start).sum(1)
    by_entry = np.argsort(start, kind="stable")
    bounds = np.searchsorted(start[by_entry], np.arange(len(book.entries) + 1))
    for entry in np.unique(start):
        rows = by_entry[bounds[entry] : bounds[entry + 1]]
        inside = np.searchsorted(book.far[entry], 4 * least[rows], side="right")
        rows, inside = rows[order := np.argsort(inside, kind="stable")], inside[order]
        at = 0
        while at < len(rows):  # points with balls of like size together
            reach = max(2 * int(inside[at]), 8)
            upto = min(int(np.searchsorted(inside, reach, side="right")), at + max(1, CHUNK // reach))
            chosen = np.sort(book.order[entry, : inside[upto - 1]])  # by index, so that argmin takes the lower one
            d = squares(points[rows[at:upto]], book.entries[chosen])
            best = d.argmin(1)
            found[rows[at:upto]] = chosen[best]
            least[rows[at:upto]] = d[np.arange(len(best)), best]
            at = upto
    return found, least


def _matrix(batch: pa.RecordBatch, at: int, width: int) -> np.ndarray:
    """The vectors of a batch as rows of `width` integers, zero beyond their end."""
    lists = batch.column(at)
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(lists), width).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place] = flat
    return out


def _assigned(books: list[np.ndarray], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [Codebook(b) for b in books]
        part = width // len(books)
        for batch in batches:
            points = _matrix(batch, 2, width)
            before = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, len(books)).astype(np.int64)
            codes = np.empty((len(points), len(books)), np.uint8)
            error = np.zeros(len(points), np.int64)
            for k, book in enumerate(ready):
                codes[:, k], least = nearest(points[:, k * part : (k + 1) * part], book, before[:, k])
                error += least
            arrays = [batch.column(0), batch.column(1), batch.column(2), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "label", "vector", "codes", "error"])

    return run


def _summed(parts: int, width: int):
    """A row for each part position and entry that a task met: slot, count, sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = width // parts
        counts = np.zeros(parts * ENTRIES, np.int64)
        sums = np.zeros((parts * ENTRIES, part), np.int64)
        for batch in batches:
            points = _matrix(batch, 0, width)
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts)
            for k in range(parts):
                slot = codes[:, k].astype(np.int64) + k * ENTRIES
                order = np.argsort(slot, kind="stable")
                met, first = np.unique(slot[order], return_index=True)
                if len(met):
                    counts += np.bincount(slot, minlength=len(counts))
                    sums[met] += np.add.reduceat(points[order, k * part : (k + 1) * part], first, axis=0)
        met = np.flatnonzero(counts)
        columns = [pa.array(met), pa.array(counts[met]), *(pa.array(sums[met, j]) for j in range(part))]
        yield pa.RecordBatch.from_arrays(columns, ["slot", "n", *(f"s{j}" for j in range(part))])

    return run


def moved(coded: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Each entry as the floor of the mean of its parts; unused entries stay."""
    part = width // len(books)
    sums = [f"s{j}" for j in range(part)]
    schema = ", ".join(f"{c} long" for c in ["slot", "n", *sums])
    tasks = coded.select("vector", "codes").mapInArrow(_summed(len(books), width), schema)
    out = [b.copy() for b in books]
    for r in tasks.groupBy("slot").agg(F.sum("n"), *(F.sum(s) for s in sums)).collect():  # at most parts * ENTRIES rows
        out[r[0] // ENTRIES][r[0] % ENTRIES] = [total // r[1] for total in r[2:]]
    return out


def train(vectors: DataFrame, parts: int = PARTS, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes and error of each vector (staged), and the final codebooks. vectors: of integer_vectors, staged."""
    longest = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-max(longest, 1) // parts) * parts
    seeds = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    first = np.zeros((len(seeds), width), np.int64)
    for k, r in enumerate(seeds):
        first[k, : len(r.vector)] = r.vector
    books = [np.ascontiguousarray(b) for b in np.split(first, parts, axis=1)]
    coded = vectors.select("*", F.lit(bytes(parts)).alias("codes"), F.lit(0).cast("long").alias("error"))
    before = None
    for k in range(rounds + 1):
        coded = stage(coded.mapInArrow(_assigned(books, width), CODED), f"codes{k}")
        if before is not None:
            unstage(before)
        before = coded
        if k < rounds:
            books = moved(coded, books, width)
    return coded, books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def compress(rows: DataFrame, column: str = "embedding", parts: int = PARTS, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, codes (a byte a part), error, label_error: one row a usable vector; and the codebooks."""
    vectors = stage(integer_vectors(rows, column), "vectors")
    coded, books = train(vectors, parts, rounds)
    unstage(vectors)
    group = F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))
    rows = coded.select("vec_id", "label", "codes", "error", group.alias("_group"))
    totals = stage(rows.groupBy("_group").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "labels")
    return lookup_by_group(rows, totals, "_group", "_n").select("vec_id", "label", "codes", "error", "label_error"), books


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row per usable vector."""
    found, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    code = F.lower(F.hex("codes"))
    return found.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
