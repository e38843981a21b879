"""Streams run to the end give what the batch operators give."""

import datetime
import random
import re

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tallyloom.operators import freshness
from tallyloom.streaming import jobs, states

OBS = "product_key string, observed_at timestamp, dispensary_id string, product_id string"
T = datetime.datetime(2026, 1, 1, 12)


def write(spark, rows, path, schema=OBS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_append_once(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    write(spark, [("a", T, "s", "p"), ("a", T, "s", "p")], source)
    jobs.append_once(jobs.file_stream(spark, source, OBS), ["product_key", "observed_at"], "observed_at", target, state).awaitTermination()
    write(spark, [("a", T, "s", "p"), ("b", T + datetime.timedelta(days=400), "s", "p")], source)
    today = jobs.not_in_future(jobs.file_stream(spark, source, OBS), "observed_at", "2026-06-01")
    jobs.append_once(today, ["product_key", "observed_at"], "observed_at", target, state).awaitTermination()
    assert [r.product_key for r in spark.read.parquet(target).collect()] == ["a"]


def test_daily_presence(spark, tmp_path):
    source = str(tmp_path / "in")
    write(spark, [("k", T, "s", "p1"), ("k", T, "s", "p2"), ("k", T, "s", "p1"), ("k", T + datetime.timedelta(days=5), "s", "p9")], source)
    stream = jobs.file_stream(spark, source, OBS).withColumnRenamed("observed_at", "ts")
    q = jobs.daily_presence(jobs.closed(stream, "ts")).writeStream.format("memory").queryName("presence").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(str(r.day), r.products, r.observations) for r in spark.table("presence").collect()} == {("2026-01-01", 2, 3), ("2026-01-06", 1, 1)}


def test_last_known_good(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "dispensary_id string, pushed_at timestamp, deal_count long, confirmed_empty boolean"
    hour = datetime.timedelta(hours=1)
    write(spark, [("a", T, 3, False), ("b", T, 2, False), ("c", T, 0, False)], source, schema)
    write(spark, [("a", T + hour, 0, False), ("b", T + hour, 0, True)], source, schema)
    q = jobs.last_known_good(jobs.file_stream(spark, source, schema)).writeStream.format("memory").queryName("good").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in spark.table("good").collect():
        last.setdefault(r.dispensary_id, []).append((r.deal_count, r.stale))
    assert last["a"][-1] == (3, True) and last["b"][-1] == (0, False) and last["c"] == [(0, True)]


def test_first_seen(spark, tmp_path):
    source = str(tmp_path / "in")
    write(spark, [("a", T, "s", "p"), ("a", T, "s", "p"), ("b", T, "s", "p")], source)
    q = jobs.first_seen(jobs.file_stream(spark, source, OBS), "product_key", "observed_at").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").select(F.col("product_key")).count() == 2


def ended(spark, stream, path):
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def test_stores_go_stale_by_silence(spark, tmp_path):
    """The stream's transitions give what the batch predicates say at several instants; pushes come late and in pieces."""
    states.keyed_state(spark)
    source, schema = str(tmp_path / "in"), "dispensary_id string, pushed_at timestamp"
    minutes = {"a": [0, 30, 500, 170, 680], "b": [5, 5, 2000], "c": [100, 280, 460, 641], "d": [3000]}
    rows = [(s, T + datetime.timedelta(minutes=m)) for s, ms in minutes.items() for m in ms]
    write(spark, [*rows[::2], (None, T), ("e", None)], source, schema)
    write(spark, rows[1::2], source, schema)
    stream = jobs.file_stream(spark, source, schema, files_per_trigger=100)
    found = ended(spark, states.store_transitions(jobs.closed(stream, "pushed_at")), str(tmp_path / "q")).cache()
    assert found.count() == found.distinct().count()
    told = spark.createDataFrame(rows, schema)
    for m in (0, 170, 171, 350, 351, 500, 860, 861, 2300, 3000, 3181, 5000):
        now = str(T + datetime.timedelta(minutes=m))
        last = told.where(F.col("pushed_at") <= F.lit(now).cast("timestamp")).groupBy("dispensary_id").agg(F.max("pushed_at").cast("string").alias("at"))
        age = freshness.age_hours(F.col("at"), now)
        want = last.select("dispensary_id", freshness.store_status(F.col("at"), now), freshness.deals_expired(F.col("at"), now), age > freshness.STORE_ALERT_HOURS)
        assert sorted(map(tuple, states.status_at(found, now).collect())) == sorted(map(tuple, want.collect())), m


class Kept:
    """The state and timers of one key, kept in memory, and how often they were asked or changed."""

    def __init__(self):
        self.states, self.timers, self.calls = {}, set(), 0

    def getMapState(self, name, *_):
        return self.states.setdefault(name, KeptMap(self))

    def getValueState(self, name, *_):
        return self.states.setdefault(name, KeptValue(self))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def listTimers(self):
        self.calls += 1
        return iter(sorted(self.timers))

    def batch(self, processor, pushes, watermark, key=("s",)):
        rows = [Row(key=key[0], micros=m[0], event=m[1]) if isinstance(m, tuple) else Row(dispensary_id=key[0], micros=m) for m in pushes]
        times = TimerValues(0, watermark)
        found = list(processor.handleInputRows(key, iter(rows), times)) if rows else []
        for at in sorted(t for t in self.timers if t <= watermark):
            found += processor.handleExpiredTimer(key, times, ExpiredTimerInfo(at))
            self.timers.discard(at)
        return [(*r,) for r in found]


class KeptValue:
    def __init__(self, handle):
        self.handle, self.value = handle, None

    def exists(self):
        self.handle.calls += 1
        return self.value is not None

    def get(self):
        self.handle.calls += 1
        return self.value

    def update(self, value):
        self.handle.calls += 1
        self.value = value

    def clear(self):
        self.update(None)


class KeptMap:
    def __init__(self, handle):
        self.handle, self.values = handle, {}

    def containsKey(self, key):
        self.handle.calls += 1
        return key in self.values

    def getValue(self, key):
        self.handle.calls += 1
        return self.values.get(key)

    def updateValue(self, key, value):
        self.handle.calls += 1
        self.values[key] = value

    def removeKey(self, key):
        self.handle.calls += 1
        self.values.pop(key, None)

    def iterator(self):
        self.handle.calls += 1
        return iter(list(self.values.items()))


def started(processor):
    handle = Kept()
    processor.init(handle)
    return handle, processor


def silences(pushes):
    """What the pushes of one store bring, by definition."""
    times = sorted({*pushes})
    for before, at, after in zip([None, *times], times, [*times[1:], None]):
        if before is None or at - before > 3 * states.HOUR:
            yield ("s", at, "ok")
        for state, hours in (("stale", 3), ("alert", 6), ("expired", 24)):
            if after is None or after - at > hours * states.HOUR:
                yield ("s", at + hours * states.HOUR, state)


def test_a_run_of_pushes_is_held_once_with_one_timer():
    """The work with the state goes with runs and batches, not with hours: these 200 hours took 821 calls."""
    handle, processor = started(states.Silence())
    pushes = [k * states.HOUR // 3 for k in range(1, 600)]
    assert handle.batch(processor, [*pushes, None], 0) == []
    assert len(handle.timers) == 1 and handle.states["hours"].values == {(0,): (pushes[0], pushes[-1])} and handle.calls < 10
    more = [pushes[-1] + k * states.HOUR for k in (1, 2)]
    told = handle.batch(processor, more, pushes[-1] // 1000)
    assert told == [("s", pushes[0], "ok")] and len(handle.timers) == 1
    assert sorted(told + handle.batch(processor, [], 10**13)) == sorted(silences([*pushes, *more])) and handle.calls < 30 and not handle.timers


def test_silences_of_pushes_in_any_order_and_batches():
    """Pushes that come late, twice and in pieces; half of the streams go on from the state and timers of an earlier version."""
    for seed in range(300):
        dealt = random.Random(seed)
        gaps = [dealt.choice([0, 1, 40, 180, 181, 359, 361, 1440, 1441, 4000]) for _ in range(60)]
        clock = [60_000_000 * sum(gaps[: k + 1]) + 10**15 for k in range(60)]
        handle, processor = started(states.Silence())
        found, pushes, watermark, before = [], [], 0, 0
        if seed % 2:
            pushes = clock[:8]
            for hour in {m // states.HOUR for m in pushes}:
                of_hour = [m for m in pushes if m // states.HOUR == hour]
                handle.states["hours"].values[(hour,)] = (min(of_hour), max(of_hour))
                handle.timers |= {-(-m // 1000) for m in (min(of_hour), *(max(of_hour) + h * states.HOUR for h in (3, 6, 24)))}
        for k in range(8 if seed % 2 else 0, 60, 4):
            some = [m - dealt.choice([0, 0, 1, 5, 20]) * states.HOUR for m in clock[k : k + 4]]
            some = [m for m in [*some, some[0]] if m > before * 1000]
            found += handle.batch(processor, dealt.sample(some, len(some)), watermark)
            pushes += some
            before, watermark = watermark, max(watermark, (max(pushes) - dealt.choice([0, 2, 6]) * states.HOUR) // 1000)
        found += handle.batch(processor, [], 10**13)
        assert sorted(found) == sorted(silences(pushes)), seed


def test_told_again_after_its_time(spark, tmp_path):
    states.keyed_state(spark)
    source, schema = str(tmp_path / "in"), "post string, ts timestamp, n long"
    day = datetime.timedelta(days=1)
    write(spark, [("a", T + 5 * day, 2), ("a", T, 1), ("b", T + day, 3), (None, T, 9), ("c", None, 9)], source, schema)
    run = lambda: ended(spark, states.told_once(jobs.file_stream(spark, source, schema, 100), "post", "ts", "n"), str(tmp_path / "q")).collect()
    assert sorted((r.key, r.event) for r in run()) == [("a", 1), ("b", 3)]
    write(spark, [("a", T + 360 * day, 4), ("b", T + 362 * day, 5), ("a", T + 361 * day, 6), ("a", T + 400 * day, 7)], source, schema)
    assert sorted((r.key, r.event) for r in run()) == [("a", 1), ("a", 6), ("b", 3), ("b", 5)]
    write(spark, [("a", T + 721 * day, 8), ("a", T + 722 * day, 9)], source, schema)
    got = run()
    assert sorted((r.key, r.event, r.at - T) for r in got)[2:3] == [("a", 9, 722 * day)] and len(got) == 5


def sent(stream):
    """The columns that a stream with state by key sends to Python."""
    return re.findall(r"(\w+)#", re.search(r"transformWithStateUDF\((.*?)\)#", stream._jdf.queryExecution().analyzed().toString())[1])


def test_told_late_and_null_rows(spark, tmp_path):
    """Events later than the delay are left out, as before; their times are not sent to Python."""
    states.keyed_state(spark)
    source, schema = str(tmp_path / "in"), "post string, TS timestamp, n long"
    day = datetime.timedelta(days=1)
    write(spark, [("a", T + 10 * day, 1), ("b", T - 9000 * day, 2), ("b", T + day, None), (None, T + day, 3), ("c", None, 4)], source, schema)
    stream = states.told_once(jobs.file_stream(spark, source, schema, 100), "post", "ts", "n", keep_days=2)
    assert sent(stream) == ["key", "micros", "event"]  # the time itself stood there too
    run = lambda: sorted(((r.key, r.event, r.at - T) for r in ended(spark, stream, str(tmp_path / "q")).collect()), key=str)
    first = run()
    assert first == [("a", 1, 10 * day), ("b", 2, -9000 * day), ("b", None, day)]
    late = [("d", T, 5), ("d", T + 9 * day, 6), ("d", T + 9 * day + datetime.timedelta(microseconds=1), 7), ("c", T + 8 * day, 8), ("e", T + 9 * day, 9), ("b", None, 10)]
    write(spark, [*late, ("e", T + 300 * 365 * day, 11)], source, schema)
    assert run() == sorted([*first, ("d", 7, 9 * day + datetime.timedelta(microseconds=1)), ("e", 11, 300 * 365 * day)], key=str)


def test_told_from_the_time_kept(spark):
    handle, processor = started(states.Once(5 * 24 * states.HOUR))
    day = 24 * states.HOUR
    assert [m for _, m, _ in handle.batch(processor, [(9 * day, 2), (day, 1), (6 * day, 4), (6 * day + 1, 6), (6 * day + 1, 5)], 0)] == [day, 6 * day + 1]
    assert handle.batch(processor, [(11 * day + 1, 7), (None, 8)], 0) == [] and handle.calls < 6
    assert handle.batch(processor, [(11 * day + 2, 9)], 7 * day // 1000) == [("s", 11 * day + 2, 9)]
    assert handle.batch(processor, [], 17 * day // 1000) == [] and handle.states["seen"].value is None and not handle.timers


def test_late_pushes_bring_nothing(spark, tmp_path):
    """Pushes later than the delay are left out, as before; their times are not sent to Python."""
    states.keyed_state(spark)
    source, schema = str(tmp_path / "in"), "dispensary_id string, pushed_at timestamp"
    hour, least = datetime.timedelta(hours=1), datetime.timedelta(microseconds=1)
    write(spark, [("a", T + 100 * hour), (None, T), ("b", None)], source, schema)
    stream = states.store_transitions(jobs.file_stream(spark, source, schema, 100))
    assert sent(stream) == ["dispensary_id", "micros"]  # the time itself stood there too
    ended(spark, stream, str(tmp_path / "q"))
    write(spark, [("c", T + 99 * hour), ("d", T + 99 * hour + least), ("a", T + 98 * hour), ("e", T + 9000 * hour)], source, schema)
    found = [(r.dispensary_id, r.at - T, r.state) for r in ended(spark, stream, str(tmp_path / "q")).collect()]
    brings = lambda s, at: [(s, at, "ok"), *((s, at + n * hour, state) for state, n in (("stale", 3), ("alert", 6), ("expired", 24)))]
    assert sorted(found) == sorted(brings("a", 100 * hour) + brings("d", 99 * hour + least))
