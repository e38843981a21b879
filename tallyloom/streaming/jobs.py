"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import new_path

def file_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def not_in_future(stream: DataFrame, ts: str, today: str) -> DataFrame:
    """Drop rows dated after today before any watermark: one bad clock would move it past everything else."""
    return stream.where(F.to_date(ts) <= F.lit(today).cast("date"))


def append_once(stream: DataFrame, keys: list[str], ts: str, target: str, checkpoint: str, delay: str = "1 day"):
    """Idempotent append: duplicates within the watermark are dropped in state, older ones against the target."""
    unique = stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema(batch.schema).option("pathGlobFilter", "*.parquet").parquet(target) if _exists(spark, target) else None
        fresh = batch if known is None else batch.join(known.select(*keys), keys, "left_anti")
        fresh.write.mode("append").parquet(target)

    return unique.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def closed(stream: DataFrame, ts: str, at: str = "2200-01-01") -> DataFrame:
    """The stream with one row more, all null but for a far time: once it is read, the watermark passes every real row.

    For sources that are used up in one batch, so that windows still open at the end come out. The row's own window never
    closes, but a later row would come too late: not for streams that go on.
    """
    spark = stream.sparkSession
    path = new_path(spark, "closing")
    row = spark.range(1).select(*[F.lit(at if f.name == ts else None).cast(f.dataType).alias(f.name) for f in stream.schema])
    row.write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def daily_presence(stream: DataFrame, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Distinct products by store and day, with observations. Exact: products are grouped by day first, which the watermark bounds."""
    by_product = stream.withWatermark(ts, delay).groupBy(F.window(ts, "1 day"), "dispensary_id", "product_id").agg(F.count("*").alias("n"))
    return (
        by_product.groupBy(F.window(F.window_time("window"), "1 day").alias("of_day"), "dispensary_id")
        .agg(F.count("product_id").alias("products"), F.sum("n").alias("observations"))
        .select(F.to_date("of_day.start").alias("day"), "dispensary_id", "products", "observations")
    )


def session_runs(stream: DataFrame, keys: list[str], ts: str = "ts", gap: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Runs of checks parted by a gap."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.session_window(ts, gap), *keys)
        .agg(F.count("*").alias("checks"))
        .select(*keys, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "checks")
    )


def last_known_good(stream: DataFrame) -> DataFrame:
    """Last good deals by store: an empty push clears them only if confirmed, else marks the store stale.

    stream: dispensary_id, pushed_at, deal_count, confirmed_empty. Pushes count by their time, whenever they come; the
    state is a row a store. For update or complete mode.
    """
    good = (F.col("deal_count") > 0) | F.coalesce(F.col("confirmed_empty"), F.lit(False))
    of_good = lambda c: F.when(good, F.col(c))
    return stream.groupBy("dispensary_id").agg(
        F.coalesce(F.max_by(of_good("deal_count"), of_good("pushed_at")), F.lit(0)).alias("deal_count"),
        F.max(of_good("pushed_at")).alias("fetched_at"),
        F.max_by(F.coalesce(~good, F.lit(True)), "pushed_at").alias("stale"),
    )


def first_seen(stream: DataFrame, key: str, ts: str, keep: str = "360 days") -> DataFrame:
    """Each key once in `keep`: the seen-set, with entries leaving the state as the watermark passes them."""
    return stream.withWatermark(ts, keep).dropDuplicatesWithinWatermark([key])
