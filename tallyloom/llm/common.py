"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components as connected_components
from ..plans.staging import delete, new_path
from ..plans.staging import drop_staged as unstage
from ..plans.staging import staged as stage

__all__ = ["connected_components", "delete", "new_path", "stage", "unstage"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

BATCH_ROWS = 1000
BATCH_BYTES = "8m"


def prepare(spark: SparkSession) -> None:
    """Settings of the session that the operators with Python tasks rely on.

    Workers on this machine can import the library; a cluster gets it with the job (--py-files). Documents
    are long, so Arrow batches hold fewer rows than Spark's 10,000 and fewer bytes than its 64 MB.
    """
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def lookup_by_group(rows: DataFrame, groups: DataFrame, key: str, size: str, share: int = 1000) -> DataFrame:
    """Inner join of rows with one-row-per-key groups whose `size` counts the rows of each key.

    A key that holds more than 1/share of all rows would fill one task of a shuffle join. There are
    fewer than `share` such keys, whatever the input, so their groups are broadcast; the others are
    joined by shuffle. Both inputs should be staged: each is read twice.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = groups.where(F.col(size) * share > total)
    cold = groups.where(F.col(size) * share <= total)
    first = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return first.unionByName(rest)


def tiles(rows: DataFrame, key: str, member: str, cap: int, share: int = 1000) -> DataFrame:
    """Add `tile`: rows that must be compared with each other share a tile of at most about 2 * cap rows.

    A key with up to `cap` rows is one tile. A larger one is dealt into b blocks and every pair of
    blocks is a tile, so each pair of its rows still meets and no task holds the whole key. Only rows
    of such keys are repeated, b times each. rows should be staged: they are read again for each use.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    large = stage(counts.where(F.col("_n") > cap), "large")
    total = rows.count()
    hot = large.where(F.col("_n") * share > total)  # fewer than `share` keys
    at_hot = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(large.where(F.col("_n") * share <= total), key, "left")
    blocks = F.ceil(F.coalesce("_n", F.lit(1)) / F.lit(cap)).cast("int")
    own = F.pmod(F.xxhash64(F.lit("tile"), F.col(member)), F.col("_b").cast("long")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("_b") - 1),
        lambda j: F.struct(F.least(j, F.col("_own")).alias("i"), F.greatest(j, F.col("_own")).alias("j")),
    )
    dealt = at_hot.unionByName(others).withColumn("_b", blocks).withColumn("_own", own).withColumn("_p", F.explode(pairs))
    return dealt.withColumn("tile", F.xxhash64(key, "_p.i", "_p.j")).drop("_n", "_b", "_own", "_p")
