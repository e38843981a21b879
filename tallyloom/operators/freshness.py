"""Freshness of stores and runs, and when to raise an alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STORE_FRESH_HOURS = 3
STORE_ALERT_HOURS = 6
DEAL_EXPIRY_HOURS = 24
RUN_FRESH_HOURS = 28
RUN_ALERT_HOURS = 50
RUN_SKEW_HOURS = 6
INGESTED_SINCE = "2020-01-01 00:00:00"


def age_hours(at: Column, now: str) -> Column:
    """Hours from a time, given as text or timestamp, to now; null where it is no time."""
    return (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.try_to_timestamp(at.cast("string")))) / 3.6e9


def store_status(at: Column, now: str) -> Column:
    age = age_hours(at, now)
    return F.when(age.isNull(), "failed").when(age <= STORE_FRESH_HOURS, "ok").otherwise("stale")


def deals_expired(at: Column, now: str) -> Column:
    return F.coalesce(age_hours(at, now) > DEAL_EXPIRY_HOURS, F.lit(True))


def run_freshness(at: Column, now: str) -> Column:
    """never-derived, future-skew, stale, fresh or late; the first two and stale raise an alert."""
    age = age_hours(at, now)
    never = age.isNull() | (F.try_to_timestamp(at.cast("string")) <= F.lit(INGESTED_SINCE).cast("timestamp"))
    return (
        F.when(never, "never-derived")
        .when(age < -RUN_SKEW_HOURS, "future-skew")
        .when(age > RUN_ALERT_HOURS, "stale")
        .when(age <= RUN_FRESH_HOURS, "fresh")
        .otherwise("late")
    )


def alert(stores: DataFrame, now: str) -> DataFrame:
    """One row: stores fresh, stores stale for long, and whether to alert. Stores never ingested are left out."""
    age = age_hours(F.col("last_fetched_at"), now)
    known = F.coalesce(F.try_to_timestamp(F.col("last_fetched_at").cast("string")) >= F.lit(INGESTED_SINCE).cast("timestamp"), F.lit(False))
    counts = stores.agg(F.count_if(known & (age <= STORE_FRESH_HOURS)).alias("fresh_count"), F.count_if(known & (age > STORE_ALERT_HOURS)).alias("stale_count"))
    return counts.withColumn("total_failure", F.col("fresh_count") == 0).withColumn("alert", F.expr("fresh_count = 0 or stale_count > 0"))
