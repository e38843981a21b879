"""Streams with state by key and timers: stores that go stale by silence, and alerts that are given once in a while."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.freshness import DEAL_EXPIRY_HOURS, STORE_ALERT_HOURS, STORE_FRESH_HOURS

HOUR = 3_600_000_000  # microseconds, as all times here
#: What a silence of so long does.
SILENCES = (("stale", STORE_FRESH_HOURS * HOUR), ("alert", STORE_ALERT_HOURS * HOUR), ("expired", DEAL_EXPIRY_HOURS * HOUR))
TRANSITIONS = "dispensary_id string, micros long, state string"
SEEN = "key string, micros long, event long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Settings of the session that these streams rely on.

    State with timers lives in RocksDB: on disk, checkpointed as changes, not in the executors' heap. Workers on this
    machine can import the library; a cluster gets it with the job (--py-files).
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")


def _millis(micros: int) -> int:
    return -(-micros // 1000)


def _micros(timed: DataFrame, ts: str) -> Column:
    """The time of a stream with a watermark, as microseconds.

    Spark leaves out late rows by the column that bears the watermark's mark, in its metadata. Microseconds are what it
    compares, so they bear the mark on and the time stays behind: it costs more to make a Python object of than a row's other columns.
    """
    return F.unix_micros(F.col(ts)).alias("micros", metadata=timed.select(ts).schema[0].metadata)


def _runs(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """First and last of the runs that pushes make, in order: within a run no silence makes a store stale."""
    runs: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if runs and low - runs[-1][1] <= STORE_FRESH_HOURS * HOUR:
            runs[-1] = (runs[-1][0], max(high, runs[-1][1]))
        else:
            runs.append((low, high))
    return runs


class Silence(StatefulProcessor):
    """A store's pushes as the first and last of each run of them, and a timer at the next that a silence would bring.

    Nothing is told before the watermark has passed it, so pushes may come in any order within the delay: they may make
    runs longer, join them or start new ones, but never part one. Runs that can bring nothing more are forgotten, so the
    state is those of two days and the delay, whatever a store pushes. A run is held under the hour of its first push; an
    hour of pushes, as earlier versions held, is a run too.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getMapState("hours", "hour long", "first long, last long")
        self.told = handle.getValueState("told", "until long")

    def _since(self) -> float:
        told = self.told.get()
        return -math.inf if told is None else told[0]

    def _held(self) -> dict[int, tuple[int, int]]:
        return {hour: (low, high) for (hour,), (low, high) in self.hours.iterator()}

    def _next(self, runs: list[tuple[int, int]], since: float) -> float:
        """The time of the next timer that is needed: every other is set when it goes off."""
        return min((_millis(at) for low, high in runs for at in (low, *(high + span for _, span in SILENCES)) if at > since), default=math.inf)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        met: dict[int, tuple[int, int]] = {}
        for _, at in rows:
            if at is None:
                continue
            low, high = met.get(at // HOUR, (at, at))
            met[at // HOUR] = (min(low, at), max(high, at))
        if not met:
            return iter(())
        held = self._held()
        runs = _runs([*held.values(), *met.values()])
        found = {low // HOUR: (low, high) for low, high in runs}
        for hour in held.keys() - found.keys():
            self.hours.removeKey((hour,))
        for hour, run in found.items():
            if held.get(hour) != run:
                self.hours.updateValue((hour,), run)
        since = self._since()
        at = self._next(runs, since)
        if at < min((t for t in self.handle.listTimers() if t * 1000 > since), default=math.inf):
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, since = timerValues.getCurrentWatermarkInMs() * 1000, self._since()
        if now <= since:
            return
        self.told.update((now,))
        held = self._held()
        runs = _runs(held.values())
        for k, (low, high) in enumerate(runs):
            after = runs[k + 1][0] if k + 1 < len(runs) else math.inf
            if since < low <= now:
                yield Row(dispensary_id=key[0], micros=low, state="ok")
            for state, span in SILENCES:
                if since < high + span <= now and after - high > span:
                    yield Row(dispensary_id=key[0], micros=high + span, state=state)
        # the last run stays as the one before the next push, a day longer
        for hour, (_, high) in held.items():
            if high + 2 * SILENCES[-1][1] <= now:
                self.hours.removeKey((hour,))
        at = self._next(runs, now)
        if at < math.inf:
            self.handle.registerTimer(at)


def store_transitions(pushes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """When each store becomes ok, stale, worth an alert, and when its deals expire.

    pushes: a stream of dispensary_id and pushed_at. A store is ok from a push that ends a silence of more than 3 hours
    on; a silence has its effects at the end of 3, 6 and 24 hours, with no push to say so. Pushes later than the delay are
    left out, as are those without a store or a time, but for what their time does to the watermark. Append mode; columns
    dispensary_id, at, state.
    """
    timed = pushes.withWatermark("pushed_at", delay)
    rows = timed.select(F.col("dispensary_id").cast("string").alias("dispensary_id"), _micros(timed, "pushed_at"))
    found = rows.groupBy("dispensary_id").transformWithState(Silence(), TRANSITIONS, "Append", "EventTime")
    return found.where("dispensary_id is not null").select("dispensary_id", F.timestamp_micros("micros").alias("at"), "state")


class Once(StatefulProcessor):
    """The time at which a key was last told; a timer forgets it when it no longer counts."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "micros long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seen, told = self.seen.get(), False
        at = None if seen is None else seen[0]
        for micros, event in sorted((micros, event) for _, micros, event in rows if micros is not None):
            if at is None or micros - at > self.keep:
                at, told = micros, True
                yield Row(key=key[0], micros=micros, event=event)
        if told:
            self.seen.update((at,))
            self.handle.registerTimer(_millis(at + self.keep) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        seen = self.seen.get()
        if seen is not None and timerValues.getCurrentWatermarkInMs() * 1000 > seen[0] + self.keep:
            self.seen.clear()
        return iter(())


def told_once(stream: DataFrame, key: str, ts: str, event: str, keep_days: int = 360, delay: str = "1 day") -> DataFrame:
    """The events that are told: the first of each key, and again the first after `keep_days` from the one told last.

    Columns key, at, event. The state is one time a key and leaves with it once the watermark is past. Rows of a key that
    come in one batch are told in the order of their time, so a batch should hold no more of a key than a task can sort.
    """
    timed = stream.withWatermark(ts, delay)
    rows = timed.select(F.col(key).cast("string").alias("key"), _micros(timed, ts), F.col(event).cast("long").alias("event"))
    found = rows.groupBy("key").transformWithState(Once(keep_days * 24 * HOUR), SEEN, "Append", "EventTime")
    return found.where("key is not null").select("key", F.timestamp_micros("micros").alias("at"), "event")


def status_at(transitions: DataFrame, now: str) -> DataFrame:
    """dispensary_id, status, expired, alerting at an instant, of stores that ever pushed before it."""
    instant = F.lit(now).cast("timestamp")
    at = lambda *states: F.max(F.when(F.col("state").isin(*states), F.col("at")))
    # a silence counts beyond its span, a push from its own time on
    past = transitions.where(F.when(F.col("state") == "ok", F.col("at") <= instant).otherwise(F.col("at") < instant))
    found = past.groupBy("dispensary_id").agg(at("ok").alias("ok"), *(at(s).alias(s) for s, _ in SILENCES))
    since = lambda s: F.coalesce(F.col(s) >= F.col("ok"), F.lit(False))
    status = F.when(since("stale"), "stale").otherwise("ok")
    return found.where("ok is not null").select("dispensary_id", status.alias("status"), since("expired").alias("expired"), since("alert").alias("alerting"))
