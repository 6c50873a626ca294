"""Interval algebra without theta joins: intervals are cut at the days they touch and meet on (pid, day)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayline.functions.columns import seconds_between


def day_windows(spine: DataFrame, first: str, last: str) -> DataFrame:
    """(pid, day, lo, hi): the window from day + `first` to day + `last`, as interval texts."""
    at = F.col("day").cast("timestamp_ntz")
    return spine.select("pid", "day", (at + F.expr(f"INTERVAL '{first}'")).alias("lo"), (at + F.expr(f"INTERVAL '{last}'")).alias("hi"))


def clip_intervals(intervals: DataFrame, windows: DataFrame, longest_days: int = 1) -> DataFrame:
    """Parts of (pid, start, end) inside each window (pid, day, lo, hi); empty parts dropped.

    A window starts within `longest_days` days of its day. Each interval is exploded to the days whose windows it can
    touch and joined on (pid, day), so the join is an equi-join however long the history.
    """
    days = F.sequence(F.date_sub(F.to_date("start"), longest_days), F.date_add(F.to_date("end"), longest_days))
    cut = intervals.withColumn("day", F.explode(days)).join(windows, ["pid", "day"])
    cut = cut.withColumn("start", F.greatest("start", "lo")).withColumn("end", F.least("end", "hi"))
    return cut.where("end > start")


def merge_intervals(intervals: DataFrame, keys: list[str], gap_minutes: float = 30.0) -> DataFrame:
    """Unions of intervals whose gaps are at most `gap_minutes`, by gaps and islands."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (seconds_between(reach, F.col("start")) > gap_minutes * 60), 1).otherwise(0)
    islands = intervals.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(w))
    return islands.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def intersect_intervals(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Overlaps of two interval tables that already are cut at `keys` (pid and day among them)."""
    other = right.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"))
    both = left.join(other, keys).withColumn("start", F.greatest("start", "_s")).withColumn("end", F.least("end", "_e"))
    return both.where("end > start").drop("_s", "_e")


def raw_records(days: DataFrame, intervals: DataFrame, points: DataFrame) -> DataFrame:
    """(pid, day, stream, n, records): the raw rows of each wanted (pid, day), each stream within its own window.

    `intervals` (stream, pid, start, end, record) count from the evening before, 20:00, and `points` (stream, pid, ts,
    record) from 04:00, both to 04:00 of the next day. Intervals are exploded to the days that they can touch, so both
    joins are equi-joins. A person's day of one stream bounds the list; records are sorted.
    """
    wanted = day_windows(days.select("pid", "day").distinct(), "-4 hours", "28 hours")
    touched = F.sequence(F.to_date(F.col("start") - F.expr("INTERVAL 28 HOURS")), F.to_date(F.col("end") + F.expr("INTERVAL 4 HOURS")))
    spans = intervals.withColumn("day", F.explode(touched)).join(wanted, ["pid", "day"]).where("end > lo and start < hi")
    dots = points.withColumn("day", F.to_date(F.col("ts") - F.expr("INTERVAL 4 HOURS"))).join(wanted, ["pid", "day"])
    rows = spans.select("pid", "day", "stream", "record").unionByName(dots.select("pid", "day", "stream", "record"))
    return rows.groupBy("pid", "day", "stream").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("record")).alias("records"))
