"""Daily markers from raw streams: locked and dark intervals, places, apps and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayline.functions.columns import behavioural_day, seconds_between
from dayline.functions.staging import staged
from dayline.operators.intervals import clip_intervals, day_windows, intersect_intervals, merge_intervals


def day_spine(bounds: DataFrame) -> DataFrame:
    """Every day of each pid between its first and last time in (pid, first, last)."""
    b = bounds.groupBy("pid").agg(F.to_date(F.min("first")).alias("d0"), F.to_date(F.max("last")).alias("d1"))
    return b.select("pid", F.explode(F.sequence("d0", "d1")).alias("day"))


def sleep_episodes(locked: DataFrame, dark: DataFrame, spine: DataFrame, least_hours: float = 2.5, most_hours: float = 12.0) -> DataFrame:
    """The night's sleep of each wake date: the longest locked stretch of fair length that began by 04:00.

    Locked intervals in [day before 20:00, 11:00) are merged over gaps of 30 minutes. Where the window has darkness,
    stretches are cut to it first; if none of these will do, the plain ones are taken.
    """
    w = day_windows(spine, "-4 hours", "11 hours")
    whole = staged(merge_intervals(clip_intervals(locked, w), ["pid", "day"]), "merged-nights")  # read three times
    dim = clip_intervals(dark, w).select("pid", "day", "start", "end")
    cut = intersect_intervals(whole, dim, ["pid", "day"])
    undimmed = whole.join(dim.select("pid", "day").distinct(), ["pid", "day"], "left_anti")
    options = cut.unionByName(undimmed).withColumn("tier", F.lit(0)).unionByName(whole.withColumn("tier", F.lit(1)))
    s = seconds_between(F.col("start"), F.col("end"))
    fair = options.withColumn("secs", s).where(F.col("secs").between(least_hours * 3600, most_hours * 3600) & (F.col("start") <= F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL 4 HOURS")))
    first = Window.partitionBy("pid", "day").orderBy("tier", F.col("secs").desc(), "start")
    best = fair.withColumn("_at", F.row_number().over(first)).where("_at = 1")
    onset = F.hour("start") + F.minute("start") / 60 + F.when(F.to_date("start") == F.col("day"), 24).otherwise(0)
    return best.select("pid", "day", "start", "end", onset.alias("onset"), (F.col("secs") / 3600).alias("duration"))


def sleep_regularity(sleep: DataFrame, spine: DataFrame, days: int = 7, least_minutes: int = 2880) -> DataFrame:
    """Agreement of sleep and wake at 24 hours' distance over the last `days` days, 0 to 100, with its coverage.

    A night found for W makes the minutes from the evening before at 18:00 to W 12:00 known. Minutes can be compared
    where W and the night before are both known; the evening belongs to W - 1 and the morning to W. In each of these
    segments the minutes that differ are |A| + |B| - 2 |A and B|, so no minute array is needed.
    """
    minute = lambda c, day: F.floor(F.timestamp_diff("SECOND", F.date_trunc("day", day.cast("timestamp_ntz")).cast("timestamp_ntz"), c) / 60)
    n = sleep.select("pid", "day", minute(F.col("start"), F.col("day")).alias("s"), minute(F.col("end"), F.col("day")).alias("e"))
    before = n.select("pid", F.date_add("day", 1).alias("day"), F.col("s").alias("s0"), F.col("e").alias("e0"))
    both = n.join(before, ["pid", "day"])
    length = lambda a, b: F.greatest(b - a, F.lit(0))

    def segment(lo: int, hi: int) -> Column:
        s, e, s0, e0 = (F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(c))) for c in ("s", "e", "s0", "e0"))
        return length(s, e) + length(s0, e0) - 2 * length(F.greatest(s, s0), F.least(e, e0))

    evening = both.select("pid", F.date_sub("day", 1).alias("day"), F.lit(360).alias("known"), segment(-360, 0).alias("differ"))
    morning = both.select("pid", "day", F.lit(720).alias("known"), segment(0, 720).alias("differ"))
    per_day = evening.unionByName(morning).groupBy("pid", "day").agg(F.sum("known").alias("known"), F.sum("differ").alias("differ"))
    w = Window.partitionBy("pid").orderBy("n").rangeBetween(-(days - 1), 0)
    out = spine.join(per_day, ["pid", "day"], "left").withColumn("n", F.datediff("day", F.lit("1970-01-01").cast("date")))
    out = out.withColumn("k", F.coalesce(F.sum("known").over(w), F.lit(0))).withColumn("x", F.sum("differ").over(w))
    enough = F.col("k") >= least_minutes
    return out.select("pid", "day", F.when(enough, 100 * (1 - F.col("x") / F.col("k"))).alias("sri"), F.when(enough, F.least(F.lit(1.0), F.col("k") / (days * 1440))).otherwise(0.0).alias("coverage"))


def unlocked_intervals(locked: DataFrame) -> DataFrame:
    """Gaps between an interval's end and the next one's start."""
    nxt = F.lead("start").over(Window.partitionBy("pid").orderBy("start", "end"))
    return locked.select("pid", F.col("end").alias("start"), nxt.alias("end")).where("end > start")


def screen_minutes(locked: DataFrame, spine: DataFrame, first: str, last: str) -> DataFrame:
    """Unlocked minutes in each day's window and the share of the window that lock evidence spans; no evidence: null."""
    w = day_windows(spine, first, last)
    used = clip_intervals(unlocked_intervals(locked), w).groupBy("pid", "day").agg((F.sum(seconds_between(F.col("start"), F.col("end"))) / 60).alias("minutes"))
    seen = clip_intervals(locked, w).groupBy("pid", "day").agg(F.min("start").alias("a"), F.max("end").alias("b"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    seen = seen.select("pid", "day", (seconds_between(F.col("a"), F.col("b")) / seconds_between(F.col("lo"), F.col("hi"))).alias("coverage"))
    out = spine.join(used, ["pid", "day"], "left").join(seen, ["pid", "day"], "left")
    cover = F.coalesce("coverage", F.lit(0.0))
    return out.select("pid", "day", F.when(cover > 0, F.coalesce("minutes", F.lit(0.0))).alias("minutes"), cover.alias("coverage"))


def dwell(places: DataFrame, cap_minutes: float = 30.0, least: int = 5) -> DataFrame:
    """Seconds at each place of a day that begins at 04:00: time to the next sample, at most `cap_minutes`."""
    d = places.withColumn("day", behavioural_day(F.col("time")))
    w = Window.partitionBy("pid", "day").orderBy("time", "event_id")
    end = F.coalesce(F.lead("time").over(w), F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL 28 HOURS"))
    d = d.withColumn("secs", F.least(F.greatest(seconds_between(F.col("time"), end), F.lit(0)), F.lit(cap_minutes * 60))).withColumn("samples", F.count(F.lit(1)).over(Window.partitionBy("pid", "day")))
    return d.where(F.col("samples") >= least).groupBy("pid", "day", "location").agg(F.sum("secs").alias("secs"))


def mobility(dwelt: DataFrame, top: int = 3) -> DataFrame:
    """Entropy of dwell in nats, share of the `top` places, coverage against twelve hours."""
    w = Window.partitionBy("pid", "day")
    d = dwelt.withColumn("total", F.sum("secs").over(w)).where("total > 0").withColumn("p", F.col("secs") / F.col("total")).withColumn("at", F.row_number().over(w.orderBy(F.col("secs").desc())))
    return d.groupBy("pid", "day").agg(
        (-F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln("p")).otherwise(0.0))).alias("entropy"), (F.sum(F.when(F.col("at") <= top, F.col("secs")).otherwise(0.0)) / F.first("total")).alias("revisit"), F.least(F.lit(1.0), F.first("total") / 43200).alias("coverage")
    )


def app_switching(apps: DataFrame, screen: DataFrame, least: int = 5, least_minutes: float = 5.0) -> DataFrame:
    """Changes of package per unlocked minute of a day."""
    d = apps.withColumn("day", behavioural_day(F.col("time")))
    before = F.lag("package").over(Window.partitionBy("pid", "day").orderBy("time", "event_id"))
    s = d.withColumn("before", before).groupBy("pid", "day").agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("before") != F.col("package")).alias("switches"))
    out = s.where(F.col("samples") >= least).join(screen, ["pid", "day"]).where(F.col("minutes") >= least_minutes)
    return out.select("pid", "day", (F.col("switches") / F.col("minutes")).alias("rate"))


def comm_reciprocity(comm: DataFrame, least: int = 3) -> DataFrame:
    """Outgoing share of a day's messages and calls."""
    d = comm.groupBy("pid", behavioural_day(F.col("time")).alias("day")).agg(F.count_if("outgoing").alias("out"), F.count(F.lit(1)).alias("n"))
    return d.where(F.col("n") >= least).select("pid", "day", (F.col("out") / F.col("n")).alias("reciprocity"))


def daily_anchors(locked: DataFrame, places: DataFrame, comm: DataFrame, home: str) -> DataFrame:
    """(pid, day, anchor, hours after 04:00): first and last unlock, first time away from home, first message.

    `home` is a pattern of home places. An unlock outside the day is left out, even if another one falls inside.
    """
    spine = locked.select("pid", F.explode(F.sequence(F.date_sub(F.to_date("start"), 1), F.to_date("end"))).alias("day")).distinct()
    touching = clip_intervals(locked.withColumn("unlock", F.col("end")), day_windows(spine, "4 hours", "28 hours"))
    ends = touching.groupBy("pid", "day").agg(F.min("unlock").alias("first_unlock"), F.max("unlock").alias("last_unlock"))
    unlocks = ends.unpivot(["pid", "day"], ["first_unlock", "last_unlock"], "anchor", "time")
    away = places.where(~F.col("location").rlike(f"(?i){home}")).groupBy("pid", behavioural_day(F.col("time")).alias("day")).agg(F.min("time").alias("time")).withColumn("anchor", F.lit("first_outside"))
    talk = comm.groupBy("pid", behavioural_day(F.col("time")).alias("day")).agg(F.min("time").alias("time")).withColumn("anchor", F.lit("first_comm"))
    hours = seconds_between(F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL 4 HOURS"), F.col("time")) / 3600
    out = unlocks.unionByName(away).unionByName(talk).withColumn("hours", hours)
    return out.where("hours >= 0 and hours < 24").select("pid", "day", "anchor", "hours")


def social_rhythm(anchors: DataFrame, days: int = 7, band: float = 1.5, least: int = 3) -> DataFrame:
    """Share of a day's anchors within `band` hours of their own median of the `days` days before."""
    a = anchors.withColumn("n", F.datediff("day", F.lit("1970-01-01").cast("date")))
    w = Window.partitionBy("pid", "anchor").orderBy("n").rangeBetween(-days, -1)
    a = a.withColumn("held", F.count("hours").over(w)).withColumn("median", F.percentile("hours", F.lit(0.5)).over(w))
    per_day = a.groupBy("pid", "day", "n").agg(F.count_if(F.col("held") >= least).alias("used"), F.count_if((F.col("held") >= least) & (F.abs(F.col("hours") - F.col("median")) <= band)).alias("hits"))
    per_day = per_day.withColumn("history", F.count(F.lit(1)).over(Window.partitionBy("pid").orderBy("n").rangeBetween(-days, -1)))
    return per_day.where((F.col("history") >= least) & (F.col("used") > 0)).select("pid", "day", (F.col("hits") / F.col("used")).alias("srm"), F.least(F.lit(1.0), F.col("history") / days).alias("coverage"))


def marker_days(locked: DataFrame, dark: DataFrame, places: DataFrame, apps: DataFrame, comm: DataFrame, spine: DataFrame, home: str, least: int = 5, least_comm: int = 3) -> DataFrame:
    """One wide row of all ten markers for each day of the spine, null where a stream gives no evidence, with coverage."""
    keys = ["pid", "day"]
    sleep = sleep_episodes(locked, dark, spine)
    total = screen_minutes(locked, spine, "4 hours", "28 hours")
    parts = [
        sleep.select(*keys, F.col("onset").alias("sleep_onset_hour"), F.col("duration").alias("sleep_duration_hours"), F.lit(1.0).alias("c_sleep")),
        sleep_regularity(sleep, spine).select(*keys, F.col("sri").alias("sleep_regularity_index"), F.col("coverage").alias("c_regularity")),
        screen_minutes(locked, spine, "-1 hours", "4 hours").select(*keys, F.col("minutes").alias("late_night_screen_min"), F.col("coverage").alias("c_late")),
        total.select(*keys, F.col("minutes").alias("total_screen_min"), F.col("coverage").alias("c_screen")),
        app_switching(apps, total, least).select(*keys, F.col("rate").alias("app_switching_rate")),
        mobility(dwell(places, least=least)).select(*keys, F.col("entropy").alias("mobility_entropy"), F.col("revisit").alias("location_revisit_ratio"), F.col("coverage").alias("c_mobility")),
        social_rhythm(daily_anchors(locked, places, comm, home)).select(*keys, F.col("srm").alias("social_rhythm_metric"), F.col("coverage").alias("c_rhythm")),
        comm_reciprocity(comm, least_comm).select(*keys, F.col("reciprocity").alias("comm_reciprocity")),
    ]
    out = spine
    for part in parts:
        out = out.join(part, keys, "left")
    given = {"sleep_onset_hour": "c_sleep", "sleep_duration_hours": "c_sleep", "sleep_regularity_index": "c_regularity", "late_night_screen_min": "c_late", "total_screen_min": "c_screen", "mobility_entropy": "c_mobility", "location_revisit_ratio": "c_mobility", "social_rhythm_metric": "c_rhythm"}
    cover = [x for m, c in given.items() for x in (F.lit(m), F.coalesce(F.col(c), F.lit(0.0)))]
    cover += [x for m in ("app_switching_rate", "comm_reciprocity") for x in (F.lit(m), F.when(F.col(m).isNotNull(), 1.0).otherwise(0.0))]
    return out.withColumn("coverage", F.create_map(*cover)).drop(*set(given.values()))
