"""Prices against their own median, kept from day to day.

A table of partials has a row per series and day (series.daily_table), a folder a day. A run writes its day and
recomputes only the series whose figures can change: those seen on the new day, on the day of the run before (their
price of today is gone), or on a day that left the window between the two. The others stand as they are.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import positive
from ..operators import series
from .envelope import exists
from .keyed import KeyedTable
from .staging import drop_staged, staged

PARTIAL = "dispensary_id string, product_id string, price double, observed_at timestamp_ntz, obs_seq long, unusable long, observations long"
COLUMNS = [f.split(" ")[0] for f in PARTIAL.split(", ")]
MEDIAN = "dispensary_id string, product_id string, outcome string, current_price double, median_price double, pct_vs_median double, observed_days long, as_of date"
KEYS = ["dispensary_id", "product_id"]


class OwnMedians:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path
        self.table = KeyedTable(spark, f"{path}/medians", KEYS, MEDIAN, buckets)

    def days(self, first: datetime.date, last: datetime.date) -> DataFrame:
        """Partials of the days from first to last; only their folders are read."""
        n = max(0, (last - first).days + 1)
        found = [d for d in (first + datetime.timedelta(k) for k in range(n)) if exists(self.spark, f"{self.path}/days/day={d}")]
        if not found:
            return self.spark.createDataFrame([], f"{PARTIAL}, day date")
        paths = [f"{self.path}/days/day={d}" for d in found]
        return self.spark.read.schema(f"{PARTIAL}, day date").option("basePath", f"{self.path}/days").parquet(*paths)

    def advance(self, observations: DataFrame, day: datetime.date, before: datetime.date) -> DataFrame:
        """Write the day's partials (again, if the day is run again) and bring the table up to it; returns the keys recomputed, staged.

        observations: of that day. before: the day of the run before; days between may be missing, as no run saw them.
        """
        own = series.daily_table(observations.where(F.to_date("observed_at") == F.lit(day)))
        own.select(*COLUMNS).write.mode("overwrite").parquet(f"{self.path}/days/day={day}")
        start = day - datetime.timedelta(series.MEDIAN_DAYS - 1)
        inside = self.days(start, day)
        moved = self.days(day, day)
        left = before - datetime.timedelta(series.MEDIAN_DAYS - 1)
        moved = moved.unionByName(self.days(before, before)).unionByName(self.days(left, start - datetime.timedelta(1)))
        return self._recompute(inside, moved, day)

    def load(self, observations: DataFrame, day: datetime.date) -> DataFrame:
        """Begin with a history up to `day`: all its partials are written and all its series computed."""
        own = series.daily_table(observations.where(F.to_date("observed_at") <= F.lit(day)))
        own.select(*COLUMNS, "day").repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/days")
        every = self.spark.read.schema(f"{PARTIAL}, day date").parquet(f"{self.path}/days")
        return self._recompute(self.days(day - datetime.timedelta(series.MEDIAN_DAYS - 1), day), every, day)

    def _recompute(self, inside: DataFrame, moved: DataFrame, day: datetime.date) -> DataFrame:
        """Upsert the medians of the series of `moved` from the partials inside the window."""
        touched = staged(moved.where(positive(F.col("price"))).select(*KEYS).distinct(), "touched")
        fresh = series.own_median(inside.join(touched, KEYS, "left_semi"), KEYS, str(day))
        gone = touched.join(fresh.select(*KEYS), KEYS, "left_anti").select(*KEYS, F.lit("below-floor").alias("outcome"), F.lit(0).cast("long").alias("observed_days"))
        both = fresh.unionByName(gone, allowMissingColumns=True).withColumn("as_of", F.lit(day))
        rows = staged(both.select(*[F.col(f.split(" ")[0]).cast(f.split(" ")[1]) for f in MEDIAN.split(", ")]), "fresh")
        self.table.upsert(rows)
        drop_staged(rows)
        return touched

    def read(self) -> DataFrame:
        return self.table.read()
