"""Clock times, countdowns and freshness phrases as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Los_Angeles"
ARTIFACT_DAYS = 14
FACT_DAYS = 2


#: H:MM or HH:MM of a day.
CLOCK = "^([01]?[0-9]|2[0-3]):[0-5][0-9]$"


def clock_minutes(time: Column) -> Column:
    """Minutes of H:MM or HH:MM, else null."""
    hour = F.substring_index(time, ":", 1).try_cast("int")
    minute = F.substring(F.substring_index(time, ":", -1), 1, 2).try_cast("int")  # an end of line may follow
    return F.when(time.rlike(CLOCK), hour * 60 + minute)


def window_open(start: Column, end: Column, minute: int) -> Column:
    """Whether a window holds at a minute of the day, whatever the weekday; one that is not stated in full is open.

    It holds where its next end comes no later than its next start. Each time stands here once: a filter reads a text
    anew for each use of it.
    """
    until = lambda time: F.pmod(clock_minutes(time) - (minute + 1), F.lit(1440))
    return F.coalesce(until(end) <= until(start), F.lit(True))


def time_of_day(time: Column) -> Column:
    """"9:05 PM"; null for no time."""
    m = clock_minutes(time)
    hour = F.floor(m / 60)
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("string")
    return F.concat(twelve, F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"), F.when(hour < 12, " AM").otherwise(" PM"))


def countdown(minutes: Column) -> Column:
    """"h:mm" of a number of minutes; null below zero."""
    whole = F.floor(minutes)
    return F.when(minutes >= 0, F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0")))


def window_text(start: Column, end: Column) -> Column:
    """How a window reads; null if a stated end is no time."""
    s, e = time_of_day(start), time_of_day(end)
    return (
        F.when(start.isNull() & end.isNull(), "Active today")
        .when((start.isNotNull() & s.isNull()) | (end.isNotNull() & e.isNull()), None)
        .when(s.isNotNull() & e.isNotNull(), F.concat(s, F.lit(" – "), e))
        .when(s.isNotNull(), F.concat(s, F.lit(" – close")))
        .otherwise(F.concat(F.lit("Until "), e))
    )


def as_of(ts: Column) -> Column:
    """The local date of an instant in words; '' for none and for the epoch."""
    at = F.try_to_timestamp(ts.cast("string"))
    return F.when(at > F.lit("1970-01-01").cast("timestamp"), F.date_format(F.from_utc_timestamp(at, ZONE), "MMMM d, yyyy")).otherwise("")


def freshness_sentence(ts: Column, stale: Column) -> Column:
    day = as_of(ts)
    last = F.concat(F.lit(" Prices last observed as of "), day, F.lit("; freshness currently unverified."))
    return (
        F.when(stale & (day != ""), last)
        .when(stale, " Freshness of these prices is currently unverified.")
        .when(day != "", F.concat(F.lit(" Prices observed as of "), day, F.lit(".")))
        .otherwise("")
    )


def older_than(ts: Column, now: str, days: float) -> Column:
    at = F.try_to_timestamp(ts.cast("string"))
    return F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(at) > int(days * 86_400_000_000)


def artifact_stale(ts: Column, now: str) -> Column:
    return F.coalesce(older_than(ts, now, ARTIFACT_DAYS), F.lit(True))


def fact_freshness(ts: Column, now: str) -> Column:
    """'' for no time, else fresh or stale."""
    old = older_than(ts, now, FACT_DAYS)
    return F.when(old.isNull(), "").when(old, "stale").otherwise("fresh")
