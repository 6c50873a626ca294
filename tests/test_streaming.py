"""Streams whose rows come late, repeated or in parts, against what a batch gives."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from dayline.functions.staging import shared_dir
from dayline.operators import device as D
from dayline.streaming import jobs
from dayline.streaming.replay import feed, replay, replay_batches, stream_settings

T0 = dt.datetime(2024, 5, 1)
at = lambda hours: T0 + dt.timedelta(hours=hours)


@pytest.fixture(autouse=True)
def settings(spark):
    shared_dir(spark)
    with stream_settings(spark):
        yield


def test_late_rows_count_while_their_day_is_open_and_are_dropped_after(spark):
    # hours from 04:00 of a day: the first step goes to hour 50, so the watermark is hour 48 in the second
    rows = [(1, at(4 + h), float(v), s) for h, v, s in [(1, 1, 0), (20, 2, 0), (30, 4, 0), (50, 8, 0), (23.9, 16, 1), (47.9, 32, 1), (49, 64, 1), (200, 0, 1), (20, 128, 2)]]
    df = spark.createDataFrame(rows, "pid int, ts timestamp, value double, step int")
    got = {r.day.day: (r.n, r.total) for r in replay(df, F.col("step"), 3, jobs.behavioural_days, "t").collect()}
    assert got == {1: (2, 3.0), 2: (1, 4.0), 3: (2, 72.0)}  # 16, 32 and 128 came after their day had been closed
    patient = {r.day.day: (r.n, r.total) for r in replay(df, F.col("step"), 3, lambda s: jobs.behavioural_days(s, "30 hours"), "t").collect()}
    assert patient == {1: (3, 19.0), 2: (2, 36.0), 3: (2, 72.0)}  # 16 and 32 came in time here


def test_sensor_windows_guard_against_a_counter_that_starts_anew(spark):
    rows = [(1, T0 + dt.timedelta(seconds=i), i, c, 1.0, 0.0, 0.0) for i, c in enumerate([10, 12, 1, 3])]
    rows += [(1, T0 + dt.timedelta(seconds=20 + i), i, c, 1.0, 0.5, 2.0 + i) for i, c in enumerate([5, 9])] + [(9, at(9), 0, 0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "device long, ts timestamp, seq long, steps long, accel double, speed double, altitude double")
    got = replay(df, F.lit(0), 1, jobs.sensor_windows, "t").where("device = 1")
    want = D.window_features(df.where("device = 1"), "15 seconds")
    assert sorted(got.collect()) == sorted(want.collect()) and sorted(r.steps for r in got.collect()) == [0, 4]


def test_periods_that_come_out_of_order_are_compared_in_order(spark):
    hours = {"a": [0, 1, 5], "b": [2, 9], "c": [7]}
    periods = [(1, at(h), f) for f, hs in hours.items() for h in hs]
    late = {at(1), at(2), at(7)}
    df = spark.createDataFrame([(*p, int(p[1] in late)) for p in periods] + [(1, at(100), "z", 2)], "device long, ts timestamp, fingerprint string, step int")
    got = replay(df, F.col("step"), 3, lambda s: jobs.changed_periods(s, "12 hours"), "t").orderBy("ts").collect()
    batch = D.unchanged(df.withColumn("start", F.col("ts"))).where("changed and fingerprint <> 'z'").orderBy("ts").collect()
    assert [(r.ts, r.fingerprint) for r in got] == [(r.ts, r.fingerprint) for r in batch] == [(at(0), "a"), (at(2), "b"), (at(5), "a"), (at(7), "c"), (at(9), "b")]


def test_a_fingerprint_is_forgotten_in_time(spark):
    df = spark.createDataFrame([(1, at(0), "a", 0), (1, at(30), "a", 1), (1, at(90), "a", 2), (2, at(500), "q", 3)], "device long, ts timestamp, fingerprint string, step int")
    got = replay(df, F.col("step"), 4, lambda s: jobs.changed_periods(s, "1 hour", 2), "t").where("device = 1").orderBy("ts").collect()
    assert [r.ts for r in got] == [at(0), at(90)]  # 30 hours keep it, 60 don't


def test_pairs_across_batches_in_any_order(spark):
    rows = [(1, at(0), 0, True, 3.0, 1), (1, at(1), 1, True, 5.0, 0), (1, at(9), 2, False, None, 1), (2, at(2), 3, True, None, 0), (3, at(0), 4, False, None, 0), (9, at(480), 5, False, None, 2)]
    df = spark.createDataFrame(rows, "device long, ts timestamp, seq long, off boolean, lux double, step int")
    got = replay(df, F.col("step"), 3, lambda s: jobs.pair_on_off(s, "10 hours"), "t").orderBy("device").collect()
    assert [(r.device, r.start, r.end, r.lux) for r in got] == [(1, at(1), at(9), 5.0), (2, at(2), at(26), None)]


class _Held:
    """State and timers of one part in memory; counts the calls."""

    def __init__(self):
        self.calls, self.states, self.timers = 0, {}, []

    def getListState(self, name, schema):
        return _Held._Of(self, name)

    getValueState = getListState

    def listTimers(self):
        self.calls += 1
        return iter(self.timers)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    class _Of:
        def __init__(self, held, name):
            self.held, self.name = held, name

        def __getattr__(self, call):
            def run(value=None):
                states = self.held.states
                self.held.calls += 1
                if call == "exists":
                    return self.name in states
                if call == "get":
                    return states[self.name]
                if call == "clear":
                    states.pop(self.name, None)
                else:
                    states[self.name] = states.get(self.name, []) + value if call == "appendList" else value

            return run


class _At:
    def __init__(self, hours):
        self.now = int(at(hours).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)

    def getCurrentWatermarkInMs(self):
        return self.now


def test_calls_of_the_state_store_dont_grow_with_the_devices():
    import pandas as pd

    def calls(devices):
        held, job = _Held(), jobs.PairOnOff(24.0)
        job.init(held)
        rows = [(str(d), at(h), d, h < 2, float(d) if h < 2 else None) for h in (3, 1) for d in range(devices)]
        frame = pd.DataFrame(rows, columns=["device", "ts", "seq", "off", "lux"])
        assert list(job.handleInputRows((0,), iter([frame[:devices], frame[devices:]]), _At(0))) == [] and held.timers == [_At(1).now - 1]
        got = pd.concat(job.handleExpiredTimer((0,), _At(2), None))
        assert got.empty and held.timers == [_At(3).now - 1]  # all are off and wait for their ons
        got = pd.concat(job.handleExpiredTimer((0,), _At(4), None))
        assert sorted(got.itertuples(index=False, name=None)) == [(d, at(1), at(3), float(d)) for d in range(devices)]
        assert not held.states and not held.timers
        return held.calls

    assert calls(500) == calls(2)


def test_many_devices_share_parts_and_keep_their_ids(spark):
    ids = [None, 2**53 + 1, 2**53, -4, *range(40)]
    rows = [(d, at(h + i % 3), None if i % 4 == 0 else i, h == 1, None if i % 5 else 1.5, int(h > 1)) for i, d in enumerate(ids) for h in (1, 7)]
    rows += [(7, None, 0, True, 0.0, 0), (99, at(480), 5, False, None, 2)]  # a row without a time is in no interval
    df = spark.createDataFrame(rows, "device long, ts timestamp, seq long, off boolean, lux double, step int")
    key = lambda rows: sorted(rows, key=str)
    want = key((d, at(1 + i % 3), at(7 + i % 3), None if i % 5 else 1.5) for i, d in enumerate(ids))
    for parts in (1, 3):
        got = replay(df, F.col("step"), 3, lambda s: jobs.pair_on_off(s, "10 hours", parts=parts), "t").collect()
        assert key((r.device, r.start, r.end, r.lux) for r in got) == want


def test_segments_stream_as_they_refine(spark):
    w = lambda d, h, m, p: (d, at(h), at(h + 1), m, p)
    rows = [w(1, 1, "still", "Cafe"), w(1, 2, "still", "Cafe North"), w(1, 3, "still", "cafe"), w(1, 4, "walk", "cafe"), w(1, 5, "walk", None), w(1, 6, "walk", None), w(1, 26, "walk", None), w(2, 23, None, "x"), w(2, 25, None, "x")]
    df = spark.createDataFrame(rows, "device long, ts timestamp, end timestamp, motion string, place string")
    done = spark.createDataFrame([(9, at(400), at(401), "", "")], df.schema)
    got = replay(df.unionByName(done).withColumn("step", (F.hour("ts") % 2).cast("int")), F.when(F.col("device") == 9, 2).otherwise(F.col("step")), 3, lambda s: jobs.refined_segments(s, "2 days"), "t")
    want = D.refine_segments(df.withColumnRenamed("ts", "start").withColumn("day", F.to_date("start")))
    key = lambda d: sorted(((r.device, r.day, r.start, r.end, r.motion, r.place) for r in d.collect()), key=str)
    assert key(got.where("device < 9")) == key(want) and len(key(want)) == 6


def journals(spark, rows):
    return spark.createDataFrame(rows, "user long, journal_id long, ts timestamp, place long, step int")


def test_a_repeated_journal_is_dropped_after_the_watermark_too(spark):
    df = journals(spark, [(1, 7, at(0), 0, 0), (1, 7, at(1), 1, 0), (1, None, at(1), 2, 0), (2, 7, at(2), 3, 0), (1, 7, at(24 * 8), 4, 1), (1, None, at(24 * 8), 5, 1), (1, 8, at(24 * 8), 6, 1), (2, 7, at(24 * 30), 7, 2), (3, 7, at(24 * 30), 8, 2)])
    store = replay_batches(df, F.col("step"), 3, jobs.new_journals, lambda f: jobs.journal_ingest(f, 4), "t")
    assert sorted(r.place for r in jobs.stored_journals(spark, store, df).collect()) == [0, 2, 3, 5, 6, 8]


def test_a_batch_that_is_tried_again_changes_nothing(spark):
    df = journals(spark, [(u, j, at(u), u * 10 + j, 0) for u in range(6) for j in range(3)])
    folder = tempfile.mkdtemp() + "/journals"
    ingest = jobs.journal_ingest(folder, 4)
    once = None
    for number, part in ((0, df.where("user < 3")), (1, df.where("user > 1")), (1, df.where("user > 1")), (0, df.where("user < 3"))):
        ingest(part, number)
        rows = sorted(r.place for r in jobs.stored_journals(spark, folder, df).collect())
        assert number == 0 or once in (None, rows)
        once = rows if number else once
    assert rows == sorted(u * 10 + j for u in range(6) for j in range(3))


def days(spark, rows):
    return spark.createDataFrame([(p, T0.date() + dt.timedelta(days=d), m, v) for p, d, m, v in rows], "pid long, day date, marker string, value double")


def _running(history):
    """Each day's sum of the three days up to it; only those above 10 are results."""
    from pyspark.sql import Window

    w = Window.partitionBy("pid", "marker").orderBy(F.datediff("day", F.lit("2024-01-01").cast("date"))).rangeBetween(-2, 0)
    return history.withColumn("total", F.sum("value").over(w)).where("total > 10").select("pid", "day", "marker", "total")


def test_late_days_change_the_days_that_they_reach(spark):
    rows = [(p, d, "m", float(d % 4 + p)) for p in (1, 2, 3) for d in range(20)]
    late = [r for r in rows if r[0] == 2 and r[1] in (3, 4, 11)]
    rows_now = [r for r in rows if r not in late]
    folder = tempfile.mkdtemp()
    ingest = jobs.deviation_ingest(folder, _running, 2)
    key = lambda d: sorted((r.pid, r.day, r.marker, r.total) for r in d.collect())
    ingest(days(spark, [r for r in rows_now if r[1] < 10]), 0)
    ingest(days(spark, [r for r in rows_now if r[1] >= 10]), 1)
    assert key(jobs.current_deviations(spark, folder)) == key(_running(days(spark, rows_now)))
    for _ in range(2):  # the second is a retry
        ingest(days(spark, late), 2)
        assert key(jobs.current_deviations(spark, folder)) == key(_running(days(spark, rows)))
    # a day that comes again with another value: its results and what they were before are replaced
    ingest(days(spark, [(1, 3, "m", -100.0)]), 3)
    changed = [r for r in rows if r[:2] != (1, 3)] + [(1, 3, "m", -100.0)]
    assert key(jobs.current_deviations(spark, folder)) == key(_running(days(spark, changed)))


def test_a_batch_reads_only_the_days_that_it_can_change_and_those_before_that_they_need(spark):
    seen = []

    def watching(history):
        seen.append(sorted((r.pid, r.day) for r in history.select("pid", "day").collect()))
        return _running(history)

    day = lambda d: T0.date() + dt.timedelta(days=d)
    folder = tempfile.mkdtemp()
    ingest = jobs.deviation_ingest(folder, watching, 2)
    rows = [(p, d, "m", float(d % 4 + p)) for p in (1, 2) for d in range(60)]
    ingest(days(spark, [r for r in rows if r[1] != 30]), 0)
    ingest(days(spark, [r for r in rows if r[1] == 30 and r[0] == 1]), 1)
    assert seen[1] == [(1, day(d)) for d in range(28, 33)]
    ingest(days(spark, [r for r in rows if r[1] == 30 and r[0] == 2]), 2)
    key = lambda d: sorted((r.pid, r.day, r.marker, r.total) for r in d.collect())
    assert key(jobs.current_deviations(spark, folder)) == key(_running(days(spark, rows)))


def test_the_rows_of_a_replay_are_worked_out_once(spark):
    worked = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            worked.add(len(part))
            yield part

    df = spark.createDataFrame([(1, at(i), float(i), i % 3) for i in range(60)] + [(1, at(9), 0.0, None)], "pid int, ts timestamp, value double, step int")
    out = replay(df.mapInPandas(count, df.schema), F.col("step"), 4, jobs.behavioural_days, "t")  # nothing comes in the last step
    assert out.agg(F.sum("n")).first()[0] > 0 and worked.value == 61


def test_a_stopped_stream_goes_on_from_its_checkpoint(spark):
    df = spark.createDataFrame([(1, at(i), float(i)) for i in range(60)], "pid int, ts timestamp, value double")
    folder = feed(df, (F.hour("ts") % 2).cast("int") * 0 + F.when(F.col("ts") < F.lit(at(30)), 0).otherwise(1), 2, lambda s, to: jobs.behavioural_days(s).writeStream.format("parquet").option("path", f"{to}/out"), "t")
    assert [(r.day.day, r.n) for r in spark.read.parquet(f"{folder}/out").orderBy("day").collect()] == [(30, 4), (1, 24), (2, 24)]
