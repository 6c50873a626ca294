"""Event-time versions of the batch operators. Each has a batch twin and agrees with it for all that the watermark has passed.

Late rows: a job forgets a window, session or key once the watermark (the latest event time of the batches before, less
the allowed lateness) has passed its end, and drops rows that belong to what it has forgotten; rows that come later
than others but before that count like any.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DataType, IntegerType, LongType, StructField, StructType

from dayline.functions.staging import staged
from dayline.operators import device
from dayline.operators.memory import first_rows


def behavioural_days(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts and sums of each person's day that begins at 04:00 (events: pid, ts, value)."""
    w = F.window("ts", "1 day", "1 day", "4 hours")
    return events.withWatermark("ts", late).groupBy("pid", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("pid", F.to_date("w.start").alias("day"), "n", "total")


def sensor_windows(samples: DataFrame, late: str = "1 minute", length: str = "15 seconds") -> DataFrame:
    """Features of each device's window, by the batch operator itself: its aggregates keep their partial results as state."""
    return device.window_features(samples.withWatermark("ts", late), length)


def weekly_means(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(pid, before, mean, days): mean of a person's daily sums over every seven days, one day apart (events: pid, ts, value).

    Two aggregations follow one another: a day enters the weeks that hold it once the watermark has closed it.
    """
    days = events.withWatermark("ts", late).groupBy("pid", F.window("ts", "1 day").alias("d")).agg(F.sum("value").alias("total"))
    days = days.select("pid", F.window_time("d").alias("at"), "total")
    weeks = days.groupBy("pid", F.window("at", "7 days", "1 day").alias("w")).agg(F.avg("total").alias("mean"), F.count(F.lit(1)).alias("days"))
    return weeks.select("pid", F.to_date("w.end").alias("before"), "mean", "days")


def merged_sessions(intervals: DataFrame, gap_seconds: int = 1800, late: str = "1 day") -> DataFrame:
    """Unions of intervals (pid, start, end) whose gaps are at most `gap_seconds`: sessions with a gap of each row's own."""
    length = F.unix_micros("end") - F.unix_micros("start") + gap_seconds * 1_000_000
    s = F.session_window("start", F.concat(length.cast("string"), F.lit(" microseconds")))
    return intervals.withWatermark("start", late).groupBy("pid", s.alias("s")).agg(F.min("start").alias("first"), F.max("end").alias("last")).select("pid", "first", "last")


def new_journals(journals: DataFrame, late: str = "7 days") -> DataFrame:
    """Journals (user, journal_id, ts, place, ...) without the repeats of an id within the watermark; rows without an id all pass.

    This spares the store most of the repeats; `journal_ingest` drops the older ones.
    """
    j = journals.withColumn("_id", F.coalesce(F.col("journal_id").cast("string"), F.concat(F.lit("row "), F.col("place").cast("string"), F.lit(" "), F.col("ts").cast("string"))))
    return j.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user", "_id"]).drop("_id")


class InOrder(StatefulProcessor):
    """Folds the rows of each device in order of time, whichever batch they come in.

    Rows wait until the watermark has passed them, and are then handed to `fold` sorted. The state that the fold keeps
    is closed by a timer once the watermark has passed `closes`, so neither rows nor states stay for ever. Rows are
    tuples whose first entry is their time, in microseconds of UTC.

    A key is a part of the devices, not a device: each call of the state store from Python is a round trip, and a
    device has few rows. A part's waiting rows are blocks, each an array for each column, one block for each frame
    that comes in; its states are one block more.
    """

    #: Columns and types of the rows that wait and of the state, whose times are longs, and of the results.
    row = state = out = ""

    def fold(self, device: int | None, state: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        """The state after the row, and the results it brings."""
        raise NotImplementedError

    def closes(self, state: tuple) -> int:
        """When a state ends by itself."""
        raise NotImplementedError

    def finish(self, device: int | None, state: tuple) -> list[tuple]:
        """The results of a state that ends by itself."""
        return []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _block("device string, " + self.row))
        self.kept = handle.getValueState("kept", _block("device string, " + self.state))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fields = _fields("device string, " + self.row)
        blocks = [tuple(_values(part[c], kind) for c, kind in fields) for part in rows]
        first = min((min(b[1]) for b in blocks if b[1]), default=None)
        if first is None:
            return
        self.waiting.appendList([b for b in blocks if b[1]])
        if first // 1000 <= timerValues.getCurrentWatermarkInMs():
            yield self._go_on(timerValues)
        else:
            self._wake(first, min(self.handle.listTimers(), default=None))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._go_on(timerValues)

    def _go_on(self, timerValues) -> pd.DataFrame:
        now = timerValues.getCurrentWatermarkInMs()
        due, rest, out = {}, [], []
        for block in self.waiting.get() if self.waiting.exists() else ():
            for device, *r in zip(*block):
                if r[0] // 1000 <= now:
                    due.setdefault(device, []).append(tuple(r))
                else:
                    rest.append((device, *r))
        states = {device: tuple(s) for device, *s in zip(*self.kept.get())} if self.kept.exists() else {}
        for name in [*due, *(d for d in states if d not in due)]:
            state, device = states.pop(name, None), None if name is None else int(name)
            for r in sorted(due.get(name, ()), key=lambda r: tuple((v is not None, v) for v in r)):
                if state is not None and r[0] >= self.closes(state):
                    out += self.finish(device, state)
                    state = None
                state, found = self.fold(device, state, r)
                out += found
            if state is not None and self.closes(state) // 1000 <= now:
                out += self.finish(device, state)
                state = None
            if state is not None:
                states[name] = state
        if due:
            self.waiting.put([tuple(list(c) for c in zip(*rest))]) if rest else self.waiting.clear()
        self.kept.update(tuple(list(c) for c in zip(*((d, *s) for d, s in states.items())))) if states else self.kept.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        ends = [r[1] for r in rest] + [self.closes(s) for s in states.values()]
        if ends:
            self._wake(min(ends), None)
        return _frame(out, self.out)

    def _wake(self, micros: int, before: int | None) -> None:
        """Sets a timer for when the watermark has passed a time, unless one comes no later; a timer fires once the watermark is beyond it."""
        at = micros // 1000 - 1
        if before is None or at < before:
            self.handle.registerTimer(at)


def _fields(columns: str) -> list[tuple[str, str]]:
    return [tuple(c.split()) for c in columns.split(", ")]


def _block(columns: str) -> str:
    return ", ".join(f"{c} array<{kind}>" for c, kind in _fields(columns))


def _values(column: pd.Series, kind: str) -> list:
    """A column's values as a block takes them: times as microseconds, no NaN, no pandas or numpy scalar."""
    if pd.api.types.is_datetime64_any_dtype(column.dtype):
        column = column.astype("datetime64[us]").astype("int64").where(column.notna())
    if not column.hasnans:
        return column.astype("int64").tolist() if kind == "long" else column.tolist()
    return [None if v is None or v != v else int(v) if kind == "long" else v for v in column.tolist()]


def _frame(rows: list[tuple], columns: str) -> pd.DataFrame:
    """Results as a frame, their times and dates made of microseconds."""
    fields = _fields(columns)
    frame = pd.DataFrame(rows, columns=[c for c, _ in fields], dtype=object)
    for c, kind in fields:
        if kind in ("timestamp", "date"):
            times = pd.to_datetime(frame[c].astype("Int64"), unit="us")
            frame[c] = times.dt.date if kind == "date" else times
    return frame


#: Microseconds of an hour.
_HOUR = 3_600_000_000


class PairOnOff(InOrder):
    """Keeps a device's last screen-off; a screen-on closes it into an interval, and so does a timer when none comes in time."""

    row, state, out = "ts long, seq long, off boolean, lux double", "at long, lux double", "device long, start timestamp, end timestamp, lux double"

    def __init__(self, longest_hours: float) -> None:
        self.longest = round(longest_hours * _HOUR)

    def fold(self, device, state, row):
        ts, _, off, lux = row
        out = [(device, state[0], ts, state[1])] if state and not off else []
        return ((ts, lux) if off else None), out

    def closes(self, state):
        return state[0] + self.longest

    def finish(self, device, state):
        return [(device, state[0], self.closes(state), state[1])]


class ChangedOnly(InOrder):
    """Lets a period pass when its fingerprint differs from the device's last, which is forgotten after `ttl_days` without one."""

    row, state, out = "ts long, fingerprint string", "at long, fingerprint string", "device long, ts timestamp, fingerprint string"

    def __init__(self, ttl_days: float) -> None:
        self.ttl = round(ttl_days * 24 * _HOUR)

    def fold(self, device, state, row):
        ts, fingerprint = row
        return (ts, fingerprint), ([] if state and state[1] == fingerprint else [(device, ts, fingerprint)])

    def closes(self, state):
        return state[0] + self.ttl


class OpenSegment(InOrder):
    """Keeps a device's open segment; a window that doesn't fit closes it, and so does the end of its day."""

    row, state = "ts long, end long, motion string, place string", "start long, end long, motion string, place string"
    out = "device long, day date, start timestamp, end timestamp, motion string, place string"

    def fold(self, device, state, row):
        ts, end, motion, place = row
        if state and state[2] == motion and _contain(state[3], place):
            longer = place if state[3] is None or len(place) >= len(state[3]) else state[3]
            return (state[0], end, motion, longer), []
        return row, (self.finish(device, state) if state else [])

    def closes(self, state):
        return (state[0] // (24 * _HOUR) + 1) * 24 * _HOUR

    def finish(self, device, state):
        return [(device, state[0], *state)]


def _contain(a: str | None, b: str | None) -> bool:
    return a == b if a is None or b is None else a.lower() in b.lower() or b.lower() in a.lower()


def _in_order(rows: DataFrame, processor: InOrder, late: str, parts: int) -> DataFrame:
    """Runs a processor over rows (device, ts, ...), in a session whose zone is UTC and whose state store is RocksDB.

    The devices fall into `parts`, as many as the checkpoint was begun with. A part's rows of a batch are together in
    memory, so a larger fleet takes more parts. Rows without a time are left out: the watermark never passes them.
    """
    # as text, an id is exact in pandas beside nulls
    rows = rows.withWatermark("ts", late).where("ts is not null").withColumn("part", F.pmod(F.xxhash64("device"), F.lit(parts))).withColumn("device", F.col("device").cast("string"))
    return rows.groupBy("part").transformWithStateInPandas(processor, processor.out, "append", "eventTime")


#: Parts of the devices in the state of jobs that fold rows in order.
PARTS = 256


def pair_on_off(rows: DataFrame, late: str = "10 minutes", longest_hours: float = 24.0, parts: int = PARTS) -> DataFrame:
    """Screen-off intervals of (device, ts, seq, off, lux), across batches. The last off before an on counts; one that stays open ends after `longest_hours`."""
    return _in_order(rows, PairOnOff(longest_hours), late, parts)


def changed_periods(rows: DataFrame, late: str = "1 day", ttl_days: float = 30.0, parts: int = PARTS) -> DataFrame:
    """Periods (device, ts, fingerprint) whose fingerprint differs from that of the device's period before."""
    return _in_order(rows, ChangedOnly(ttl_days), late, parts)


def refined_segments(windows: DataFrame, late: str = "1 hour", parts: int = PARTS) -> DataFrame:
    """Neighbouring windows (device, ts, end, motion, place) of a day folded where the motion is equal and one place contains the other."""
    return _in_order(windows, OpenSegment(), late, parts)


def journal_ingest(folder: str, parts: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that stores the journals of a batch whose (user, journal_id) isn't stored yet, the first by (ts, place); null ids all.

    The store in `folder` has a partition for each batch and part of the users. A batch that is tried again doesn't see
    its own rows and replaces them, so it changes nothing; only the parts that hold the batch's users are read.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("part", F.pmod(F.xxhash64("user"), F.lit(parts)).cast("int"))
        known = fresh.where("journal_id is not null")
        if _has_rows(spark, folder):
            touched = [r[0] for r in fresh.select("part").distinct().collect()]  # `parts` at most
            stored = _store(spark, folder, batch).where((F.col("batch") != number) & F.col("part").isin(touched))
            known = known.join(stored.select("part", "user", "journal_id"), ["part", "user", "journal_id"], "left_anti")
        known = first_rows(known, ["user", "journal_id"], [F.col("ts"), F.col("place")])
        out = known.select(fresh.columns).unionByName(fresh.where("journal_id is null"))
        out.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/batch={number}")

    return run


def _has_rows(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _store(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """All rows of a store written by batch and part."""
    return spark.read.schema(_with(like, batch=LongType(), part=IntegerType())).parquet(folder)


def _with(like: DataFrame, **more: DataType) -> StructType:
    return StructType([*like.schema.fields, *[StructField(k, t) for k, t in more.items()]])


def stored_journals(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    return _store(spark, folder, like).drop("batch", "part")


def deviation_ingest(folder: str, detect: Callable[[DataFrame], DataFrame], reach_days: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: stores a batch of marker days (pid, day, marker, ...) and computes again what they can change.

    A late day changes its own results and those of the `reach_days` after it. The batch's rows, and the results of all
    days it touches, each go to a folder of the batch's own, which a second try replaces: the same batch twice gives one
    result. Of the people in the batch, only the touched days and the `reach_days` before them are read again, however
    long their history is. A touched day has a row without marker, so that results that no longer hold go
    (`current_deviations`).
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{folder}/history/batch={number}")
        mine = spark.read.schema(batch.schema).parquet(f"{folder}/history/batch={number}")
        touched = staged(mine.groupBy("pid").agg(F.min("day").alias("since"), F.date_add(F.max("day"), reach_days).alias("until")), "touched")
        history = spark.read.schema(_with(batch, batch=LongType())).parquet(f"{folder}/history").where(F.col("batch") <= number)
        days = history.join(touched, "pid").where(F.col("day").between(F.date_sub("since", reach_days), F.col("until"))).drop("since", "until")
        newest = Window.partitionBy("pid", "marker", "day").orderBy(F.col("batch").desc())
        days = days.repartition("pid").withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "batch")  # one shuffle for all windows
        again = detect(days).join(touched, "pid").where("day between since and until").drop("since", "until")
        marks = touched.select("pid", F.explode(F.sequence("since", "until")).alias("day"))
        again.unionByName(marks, allowMissingColumns=True).write.mode("overwrite").parquet(f"{folder}/results/batch={number}")

    return run


def current_deviations(spark: SparkSession, folder: str) -> DataFrame:
    """The results that hold: of each (pid, day) those of the newest batch that touched it."""
    rows = spark.read.parquet(f"{folder}/results")
    last = F.max("batch").over(Window.partitionBy("pid", "day"))
    return rows.withColumn("_last", last).where("batch = _last and marker is not null").drop("_last", "batch")
