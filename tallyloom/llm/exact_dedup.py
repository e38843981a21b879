"""Exact dedup against a persistent digest index (DataFrame functions only).

The index is a table bucketed and sorted by digest, one row per distinct normalised text. A batch is
reduced to its distinct digests before any shuffle of single rows, a sort-merge anti-join that reads the
index in its buckets finds the new ones, and these are appended; decisions are then read off the index.
A batch that is run again under the same name appends nothing twice and decides the same.

Defined cases: a null text counts as empty; equal means identical after lower-casing A-Z only; of the
equal texts of a batch the largest doc_id stays (a null doc_id is smaller than any other); rows that
repeat both doc_id and text share one decision; a text that the index held before the batch keeps the
doc_id recorded then, and no row of the batch stays for it. Other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.envelope import exists
from ..plans.staging import shared_dir
from .common import ascii_lower, delete, lookup_by_group, stage, whole_text

BUCKETS = 64
COLUMNS = "text_sha256 string, keep_id long, batch string"


class DigestIndex:
    """A digest index kept as a bucketed table; `name` makes it persistent across batches and sessions.

    A named index lies under a path of its name in the shared folder, with its number of buckets beside it,
    and is registered from there in whatever session opens it. buckets: fixed when the index is made; by
    default as many as shuffle partitions, 64 at least.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.home = f"{shared_dir(spark)}/tallyloom/index/{self.name}"
        self.path, layout = f"{self.home}/rows", f"{self.home}/layout"
        if exists(spark, f"{layout}/_SUCCESS"):
            self.buckets = spark.read.schema("buckets int").json(layout).first()[0]
        elif exists(spark, self.path):
            raise ValueError(f"{self.path} holds rows of an index whose layout is lost")
        else:
            self.buckets = buckets or max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
            spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.mode("overwrite").json(layout)

    def read(self) -> DataFrame:
        if not self.spark.catalog.tableExists(self.name):
            by = f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS"
            self.spark.sql(f"CREATE TABLE `{self.name}` ({COLUMNS}) USING parquet {by} LOCATION '{self.path}'")
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """rows: text_sha256, keep_id, batch. One file a bucket and batch."""
        self.read()
        dealt = rows.repartition(self.buckets, "text_sha256").write.bucketBy(self.buckets, "text_sha256").sortBy("text_sha256")
        dealt.mode("append").saveAsTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS `{self.name}`")
        delete(self.spark, self.home)


def digests(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(ascii_lower(whole_text()), 256).alias("text_sha256"))


def dedup_batch(documents: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Decide every row of the batch and add its new texts to the index.

    Returns doc_id, keep_id, group_size (rows of the batch with this text), kept, text_sha256.
    """
    batch = batch or uuid.uuid4().hex
    rows = stage(digests(documents), "digests")
    counted = rows.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = stage(counted, "groups")
    new = groups.join(index.read().select("text_sha256").hint("merge"), "text_sha256", "left_anti")
    index.append(new.select("text_sha256", "keep_id", F.lit(batch).alias("batch")))
    known = index.read().select("text_sha256", "keep_id", (F.col("batch") == batch).alias("is_new"))
    decided = stage(groups.drop("keep_id").join(known.hint("merge"), "text_sha256"), "decided")
    return lookup_by_group(rows, decided, "text_sha256", "group_size").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("is_new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def kept_rows(documents: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The documents that stay, one row for each text: decisions go back by doc_id and digest, null ids included.

    Of rows that repeat both doc_id and text one stays. Without an index the documents are all there is.
    """
    spark = documents.sparkSession
    own = index or DigestIndex(spark)
    decided = stage(dedup_batch(documents, own).select("doc_id", "text_sha256", "kept"), "kept")
    if index is None:
        own.drop()
    key, digest = F.col("doc_id").cast("long"), F.sha2(ascii_lower(whole_text()), 256)
    named = documents.select(F.struct(*documents.columns).alias("_row"), key.alias("_id"), digest.alias("_digest"))
    gone = decided.where("not kept").select("doc_id", "text_sha256").distinct()
    met = named["_id"].eqNullSafe(gone["doc_id"]) & (named["_digest"] == gone["text_sha256"])
    left = named.join(gone, met, "left_anti")
    counts = decided.where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"))
    repeated = stage(counts.where("n > 1").drop("n"), "repeated")
    if repeated.take(1):
        met = left["_id"].eqNullSafe(repeated["doc_id"]) & (left["_digest"] == repeated["text_sha256"])
        one = left.join(repeated, met, "left_semi").groupBy("_id", "_digest").agg(F.any_value("_row").alias("_row"))
        left = left.join(repeated, met, "left_anti").select("_row").unionByName(one.select("_row"))
    return left.select("_row.*")


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark)
    found = dedup_batch(spark.read.parquet(f"{sf_dir}/documents.parquet"), index)
    index.drop()  # decisions are staged; this query's index serves no later batch
    return found


EXACT_DEDUP_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
