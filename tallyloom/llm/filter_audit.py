"""Audit of how five text filters interact, by the Walsh-Hadamard transform.

A document's failures are a mask of five bits, A lowest. For each of the 32 subsets S of the filters one signed
parity sum is kept by part and label: the sum of (-1)^popcount(mask & S). That is one hash aggregate, combined
before its shuffle, with a row for each part and label. The transform is its own inverse but for a factor 32, so
the counts of the 32 masks come back exactly, in integers. All 120 orders are then read off the counts: what a
filter removes at its step are the masks that hold its bit and none of the bits before it. The Shapley sum needs
no order: a mask of c failures is removed by each of its filters in 120 / c of the 120 orders.

A: under 200 words. B: 100 * distinct words < 50 * words. C: 100 * capitals A-Z > 3 * code points. D: holds one
of # $ % & * |. E: identical to the text of a smaller doc_id, whatever its part, removed or not.

Defined cases: a null text counts as empty, a null lang as the empty string; a null doc_id is neither smaller
nor larger than another and has no label; rows that repeat both doc_id and text are judged alike; of several
labels of a doc_id any 1 counts; columns beside doc_id, text and lang are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lookup_by_group, stage, unstage, whole_text

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"
LABELS = ("all", "good", "toxic")


def own_failures(text: str) -> int:
    """The bits of A to D, which rest on the text alone."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes are split at 20 and 09-0D only
    n = len(words)
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    found = (n < 200, 100 * len(set(words)) < 50 * n, 100 * capitals > 3 * len(text), len(raw.translate(None, SYMBOLS)) < len(raw))
    return sum(bit << k for k, bit in enumerate(found))


@F.arrow_udf(T.IntegerType())
def own_mask(texts: pa.Array) -> pa.Array:
    return pa.array([own_failures(t.as_py()) for t in texts], pa.int32())


def failure_masks(documents: DataFrame) -> DataFrame:
    """doc_id, part, mask: one row a document. Texts leave their task as digests only; the result is staged."""
    columns = {"doc_id": F.col("doc_id").cast("long"), "part": F.coalesce(F.col("lang").cast("string"), F.lit("")), "_text": whole_text()}
    texts = documents.select(*(c.alias(n) for n, c in columns.items()))
    rows = stage(texts.select("doc_id", "part", own_mask("_text").alias("_own"), F.unhex(F.sha2("_text", 256)).alias("_digest")), "own_masks")
    groups = stage(rows.groupBy("_digest").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")), "texts")
    later = F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False)).cast("int")
    found = lookup_by_group(rows, groups, "_digest", "_n").select("doc_id", "part", (F.col("_own") + F.shiftleft(later, 4)).alias("mask"))
    masks = stage(found, "masks")
    unstage(rows)
    unstage(groups)
    return masks


def labelled(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, label, mask: each document once as `all`, and once more for each label that it has."""
    one = lambda c: F.max((F.col(c) == 1).cast("int"))
    known = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(one("quality").alias("_good"), one("toxic").alias("_toxic"))
    kinds = F.array(F.when(F.col("_good") == 1, F.lit("good")), F.when(F.col("_toxic") == 1, F.lit("toxic")))
    told = masks.join(known, "doc_id").select("part", F.explode(F.array_compact(kinds)).alias("label"), "mask")
    return masks.select("part", F.lit("all").alias("label"), "mask").unionByName(told)


def parity(mask: Column, subset: Column) -> Column:
    """(-1) to the number of failures of the mask within the subset."""
    return F.lit(1) - F.bit_count(mask.bitwiseAND(subset)) % 2 * 2


def _added(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def parity_sums(rows: DataFrame) -> DataFrame:
    """32 signed sums by part and label, in one array."""
    sums = [F.sum(parity(F.col("mask"), F.lit(s))).alias(f"_s{s}") for s in range(MASKS)]
    return rows.groupBy("part", "label").agg(*sums).select("part", "label", F.array(*(f"_s{s}" for s in range(MASKS))).alias("sums"))


def inverted(sums: Column) -> Column:
    """The counts of the 32 masks: the transform of the sums, divided by 32 without rest."""
    masks = F.sequence(F.lit(0), F.lit(MASKS - 1))
    return F.transform(masks, lambda m: F.shiftright(_added(F.transform(sums, lambda w, s: w * parity(m, s))), 5))


def mask_cells(rows: DataFrame) -> DataFrame:
    """all, good, toxic: arrays of 32 counts by part."""
    cells = parity_sums(rows).select("part", "label", inverted(F.col("sums")).alias("_cells"))
    none = F.array_repeat(F.lit(0).cast("long"), MASKS)
    return cells.groupBy("part").agg(*(F.coalesce(F.any_value(F.when(F.col("label") == x, F.col("_cells")), ignoreNulls=True), none).alias(x) for x in LABELS))


def _steps() -> Column:
    """(filter_order, step, bit, before) for the 5 steps of each of the 120 orders."""
    steps = []
    for order in ORDERS:
        before = 0
        for k, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            steps.append(f"struct('{order}' as filter_order, {k + 1} as step, {bit} as bit, {before} as before)")
            before |= bit
    return F.expr(f"array({', '.join(steps)})")


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    masks = failure_masks(documents)
    parts = mask_cells(labelled(masks, labels))
    steps = parts.select("part", *(F.col(x).alias(f"_{x}") for x in LABELS), F.explode(_steps()).alias("_step"))
    steps = steps.select("*", "_step.filter_order", "_step.step", F.col("_step.bit").alias("_bit"), F.col("_step.before").alias("_before"))

    def over(cells: str, worth) -> Column:
        """Sum of a part's counts times what each mask is worth at this step."""
        return _added(F.transform(F.col(cells), lambda n, m: n * worth(m)))

    bit, before = F.col("_bit"), F.col("_before")
    no = lambda x: (x == 0).cast("int")
    fails = lambda m: 1 - no(m.bitwiseAND(bit))
    unmet = lambda m: no(m.bitwiseAND(before))
    removed = lambda m: fails(m) * unmet(m)
    share = lambda m: fails(m) * (F.lit(120) / F.bit_count(m.bitwiseOR(bit))).cast("long")
    return steps.select(
        "part",
        "filter_order",
        "step",
        over("_all", lambda m: unmet(m) * (1 - fails(m))).alias("kept"),
        over("_all", removed).alias("removed"),
        over("_all", lambda m: fails(m) * (1 - unmet(m))).alias("redundant"),
        over("_all", lambda m: (m == bit).cast("int")).alias("unique_fails"),
        over("_good", removed).alias("good_lost"),
        over("_toxic", removed).alias("toxic_lost"),
        over("_all", share).alias("shapley"),
    )


def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


FILTER_AUDIT_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
f AS (
  SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM w),
l AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (
  SELECT part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int AS mask, count(*) AS n,
         count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM x p, x q, x r, x s, x t WHERE (p.bit | q.bit | r.bit | s.bit | t.bit) = 31),
k AS (
  SELECT filter_order, s.step, bits[s.step] AS bit, coalesce(list_sum(bits[1:s.step - 1]), 0)::int AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step) s),
r AS (
  SELECT part, filter_order, step, bit, mask, m.n, m.good, m.toxic, mask & bit > 0 AS fails, mask & before > 0 AS earlier FROM m, k)
SELECT part, filter_order, step::int AS step,
       coalesce(sum(n) FILTER (WHERE NOT fails AND NOT earlier), 0)::bigint AS kept,
       coalesce(sum(n) FILTER (WHERE fails AND NOT earlier), 0)::bigint AS removed,
       coalesce(sum(n) FILTER (WHERE fails AND earlier), 0)::bigint AS redundant,
       coalesce(sum(n) FILTER (WHERE mask = bit), 0)::bigint AS unique_fails,
       coalesce(sum(good) FILTER (WHERE fails AND NOT earlier), 0)::bigint AS good_lost,
       coalesce(sum(toxic) FILTER (WHERE fails AND NOT earlier), 0)::bigint AS toxic_lost,
       coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (WHERE fails), 0)::bigint AS shapley
FROM r GROUP BY part, filter_order, step
"""
