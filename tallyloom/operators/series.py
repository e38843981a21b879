"""Time series with gaps: the day walk and the facts that follow from presence and absence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import positive, r4

BASELINE_DAYS = 14
MIN_BASELINE_DAYS = 5
COLLAPSE_RATIO = 0.5
MEDIAN_DAYS = 30
MIN_MEDIAN_DAYS = 7
ABSENT_RUNS = 2


def last_of_day(observations: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """One row per key and day with the value of the day's last observation."""
    return observations.groupBy(*keys, "day").agg(F.max_by(value, F.struct(*order)).alias("value"))


def daily_table(observations: DataFrame) -> DataFrame:
    """One row per store, product and day: what the facts over series need of the day's observations.

    special and brand: of the day's last observation; price: of its latest usable one; unusable: observations without
    a usable price. It has the columns of the observations, so the facts read it in their place, and it is the table of
    partials that a run appends a day to.
    """
    usable = positive(F.col("price"))
    at = F.when(usable, F.struct("observed_at", "obs_seq"))
    return observations.groupBy("dispensary_id", "product_id", "day").agg(
        F.max_by("brand", "obs_seq").alias("brand"),
        F.max_by("special", "obs_seq").alias("special"),
        F.max_by("price", at).alias("price"),
        F.max("observed_at").alias("observed_at"),
        F.max("obs_seq").alias("obs_seq"),
        F.count_if(~usable).alias("unusable"),
        F.count("*").alias("observations"),
    )


def day_walk(daily: DataFrame, keys: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """daily: keys, day, value. One row per key and calendar day: status gap, first, unchanged or changed.

    The walk goes from `start` (else a key's first day) to `end` (else its last); `first` starts anew at
    an explicit start. The previous value skips gaps: a gap is no change.
    """
    if start is not None and end is not None and start > end:
        raise ValueError(f"start {start} is after end {end}")
    low = F.lit(start).cast("date") if start else F.min("day")
    high = F.lit(end).cast("date") if end else F.max("day")
    inside = daily
    if start:
        inside = inside.where(F.col("day") >= F.lit(start).cast("date"))
    if end:
        inside = inside.where(F.col("day") <= F.lit(end).cast("date"))
    spans = daily.groupBy(*keys).agg(low.alias("_low"), high.alias("_high")).where("_low <= _high")
    calendar = spans.select(*keys, F.explode(F.sequence("_low", "_high")).alias("day"))
    seen = calendar.join(inside.withColumn("_seen", F.lit(True)), [*keys, "day"], "left")
    before = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    walked = seen.withColumn("previous", F.last("value", ignorenulls=True).over(before)).withColumn(
        "_had", F.coalesce(F.max("_seen").over(before), F.lit(False))
    )
    status = (
        F.when(F.col("_seen").isNull(), "gap")
        .when(~F.col("_had"), "first")
        .when(F.col("value").eqNullSafe(F.col("previous")), "unchanged")
        .otherwise("changed")
    )
    return walked.select(*keys, "day", status.alias("status"), "value", F.when(status == "changed", F.col("previous")).alias("previous"))


def extraction_health(observations: DataFrame, roster: DataFrame, today: str) -> DataFrame:
    """By store of the roster: today's distinct products against the median of the 14 days before."""
    day = F.lit(today).cast("date")
    window = observations.where((F.col("day") >= F.date_sub(day, BASELINE_DAYS)) & (F.col("day") <= day))
    daily = window.groupBy("dispensary_id", "day").agg(F.countDistinct("product_id").alias("n"))
    trailing = F.when(F.col("day") < day, F.col("n"))
    sums = daily.groupBy("dispensary_id").agg(
        F.max(F.when(F.col("day") == day, F.col("n"))).alias("today_count"), F.median(trailing).alias("_median"), F.count(trailing).alias("observed_days")
    )
    joined = roster.select("dispensary_id").join(sums, "dispensary_id", "left").withColumn("observed_days", F.coalesce("observed_days", F.lit(0)))
    enough = F.col("observed_days") >= MIN_BASELINE_DAYS
    collapsed = F.col("today_count").isNull() | (F.col("today_count") < F.col("_median") * COLLAPSE_RATIO)
    status = F.when(~enough, "insufficient-history").when(collapsed, "suspected-extraction-failure").otherwise("ok")
    return joined.select("dispensary_id", status.alias("status"), "today_count", F.when(enough, F.col("_median")).alias("trailing_median"), "observed_days")


def special_states(observations: DataFrame, today: str) -> DataFrame:
    """By product, what its last `special` of today says against that of the last day it was seen before.

    state: special-start, special-end, unchanged, first or gap (not seen today).
    """
    keys = ["dispensary_id", "product_id"]
    day = F.lit(today).cast("date")
    daily = last_of_day(observations, keys, "special", ["obs_seq"])
    now = F.max(F.when(F.col("day") == day, F.col("value")))
    before = F.max_by(F.when(F.col("day") < day, F.col("value")), F.when(F.col("day") < day, F.col("day")))
    found = daily.groupBy(*keys).agg(now.alias("now"), before.alias("before"))
    state = (
        F.when(F.col("now").isNull(), "gap")
        .when(F.col("before").isNull(), "first")
        .when(F.col("now") == F.col("before"), "unchanged")
        .when(F.col("now"), "special-start")
        .otherwise("special-end")
    )
    return found.select(*keys, state.alias("state"))


def arrivals_and_dormancy(observations: DataFrame, status: DataFrame, today: str, absent_runs: int = ABSENT_RUNS) -> DataFrame:
    """By product: arrival, onboarding, present, suppressed, dormant or below-threshold, with last day and absent runs.

    A store's runs are the days it was seen at all. A product unseen today is dormant if it missed at
    least `absent_runs` of the store's latest runs, and only at a store whose extraction is healthy.
    """
    keys = ["dispensary_id", "product_id"]
    day = F.lit(today).cast("date")
    runs = observations.select("dispensary_id", "day").distinct()
    order = Window.partitionBy("dispensary_id").orderBy("day")
    numbered = runs.where(F.col("day") <= day).withColumn("run", F.row_number().over(order))
    last_run = numbered.groupBy("dispensary_id").agg(F.max("run").alias("last_run"))
    earliest = runs.groupBy("dispensary_id").agg(F.min("day").alias("store_first"))
    seen = observations.where(F.col("day") <= day).groupBy(*keys).agg(F.min("day").alias("first_seen"), F.max("day").alias("last_seen"))
    at = seen.join(numbered.select("dispensary_id", F.col("day").alias("last_seen"), "run"), ["dispensary_id", "last_seen"])
    known = at.join(last_run, "dispensary_id").join(earliest, "dispensary_id").join(status.select("dispensary_id", "status"), "dispensary_id", "left")
    absent = F.col("last_run") - F.col("run")
    outcome = (
        F.when((F.col("first_seen") == day) & (F.col("store_first") < day), "arrival")
        .when(F.col("first_seen") == day, "onboarding")
        .when(F.col("last_seen") == day, "present")
        .when(F.coalesce("status", F.lit("")) != "ok", "suppressed")
        .when(absent >= absent_runs, "dormant")
        .otherwise("below-threshold")
    )
    return known.select(*keys, outcome.alias("outcome"), "first_seen", "last_seen", absent.cast("long").alias("absent_runs"))


def own_median(prices: DataFrame, keys: list[str], today: str) -> DataFrame:
    """By series: today's price against the median of its daily prices of the last 30 days, today included.

    prices: keys, day, observed_at, obs_seq, price. A day's price is that of its latest usable observation.
    outcome: below-floor (under 7 days), no-observation-today, at-median, below-median or above-median.
    """
    day = F.lit(today).cast("date")
    usable = prices.where(positive(F.col("price")))
    window = F.when((F.col("day") >= F.date_sub(day, MEDIAN_DAYS - 1)) & (F.col("day") <= day), F.col("value"))
    daily = last_of_day(usable, keys, "price", ["observed_at", "obs_seq"])
    found = daily.groupBy(*keys).agg(
        F.count(window).alias("observed_days"), F.median(window).alias("_median"), F.max(F.when(F.col("day") == day, F.col("value"))).alias("current_price")
    )
    median = r4(F.col("_median"))
    pct = r4((F.col("current_price") - F.col("_median")) / F.col("_median"))
    outcome = (
        F.when(F.col("observed_days") < MIN_MEDIAN_DAYS, "below-floor")
        .when(F.col("current_price").isNull(), "no-observation-today")
        .when(pct < 0, "below-median")
        .when(pct > 0, "above-median")
        .otherwise("at-median")
    )
    return found.select(*keys, outcome.alias("outcome"), "current_price", median.alias("median_price"), pct.alias("pct_vs_median"), "observed_days")


def sessions(rows: DataFrame, keys: list[str], ts: str, order: list[str], gap_minutes: int = 10) -> DataFrame:
    """Add run: it rises where more than the gap passed since the row before, and at every row without a time.

    Rows are ordered within a day of a key; the days of a key, one row each, are chained apart. So no
    task holds more than a day of a key, however long its history.
    """
    by_day = [*keys, "_day"]
    renamed = {c: f"_of_{c}" for c in by_day}
    same_day = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in renamed.items()])
    dated = rows.withColumn("_day", F.to_date(ts))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    days = Window.partitionBy(*keys).orderBy(F.col("_day").asc_nulls_first())
    ends = dated.groupBy(*by_day).agg(F.max(ts).alias("_last")).withColumn("_before", F.lag("_last").over(days)).drop("_last")
    axis = Window.partitionBy(*by_day).orderBy(F.col(ts).asc_nulls_first(), *order)
    met = dated.join(ends.withColumnsRenamed(renamed), same_day, "left").drop(*renamed.values())
    gap = micros(F.col(ts)) - micros(F.coalesce(F.lag(ts).over(axis), F.col("_before")))
    marked = met.withColumn("_starts", F.when(gap.isNull() | (gap > gap_minutes * 60_000_000), 1).otherwise(0)).drop("_before")
    sums = marked.groupBy(*by_day).agg(F.sum("_starts").alias("_sum"))
    before = days.rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    numbered = marked.withColumn("_own", F.sum("_starts").over(axis))
    joined = numbered.join(bases.withColumnsRenamed(renamed), same_day)
    return joined.withColumn("run", F.col("_base") + F.col("_own")).drop(*renamed.values(), "_day", "_starts", "_own", "_base")
