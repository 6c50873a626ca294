"""Aggregation of device logs: sensor windows, motion, grid cells, context reuse, segments, screen pairs and battery."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayline.functions import registry
from dayline.functions.columns import clip, seconds_between

METERS_PER_DEGREE = 111_320.0


def window_features(samples: DataFrame, length: str = "15 seconds") -> DataFrame:
    """(device, start): steps since the window's first count, mean acceleration, change of altitude, last speed."""
    w = samples.groupBy("device", F.window("ts", length).alias("w"))
    order = F.struct("ts", "seq")
    first, last = (lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order))), (lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)))
    f = w.agg(first("steps").alias("s0"), last("steps").alias("s1"), F.avg("accel").alias("accel"), first("altitude").alias("a0"), last("altitude").alias("a1"), last("speed").alias("speed"))
    steps = F.when(F.col("s1") >= F.col("s0"), F.col("s1") - F.col("s0")).otherwise(0)
    return f.select("device", F.col("w.start").alias("start"), steps.alias("steps"), "accel", F.coalesce(F.col("a1") - F.col("a0"), F.lit(0.0)).alias("altitude_delta"), "speed")


def motion_candidates(steps: Column, accel: Column, climb: Column, speed: Column) -> Column:
    """Names of the motions that a window's features allow, in a fixed order; never empty."""
    level = F.abs(climb)
    # fixed values: steps of a window and speeds in m/s
    rules = [
        ("stationary", (steps <= 2) & (accel <= 0.1) & (level <= 0.1) & (speed <= 0.1)),
        ("jogging/running", (steps >= 140) & speed.between(2.0, 5.0)),
        ("walking", (steps >= 50) & (speed < 1.8)),
        ("cycling", (steps >= 50) & (speed >= 4.0)),
        ("vehicle/subway/ferry/train", ((steps <= 10) & (speed > 2.0)) | (speed > 5.0)),
        ("escalator/elevator", (steps <= 10) & (climb > 2.5) & (speed < 2.0)),
        ("limited motion", (steps <= 10) & (level <= 1.0) & (speed < 0.5)),
    ]
    found = F.array_compact(F.array(*[F.when(test, name) for name, test in rules]))
    spare = F.when((steps >= 50) & (speed >= 0.5) & (speed < 2.0), "walking").when(steps > 2, "limited motion").otherwise("stationary")
    return F.when(F.size(found) > 0, found).otherwise(F.array(spare))


def grid_key(lat: Column, lon: Column, meters: float = 100.0, accuracy: Column | None = None, worst: float = 50.0) -> Column:
    """Cell of about `meters` on a side, as text; null for an unusable position, or one whose accuracy is worse than `worst` meters."""
    scale = METERS_PER_DEGREE * F.greatest(F.cos(F.radians(lat)), F.lit(0.1))
    key = F.concat_ws(":", F.floor(lat * METERS_PER_DEGREE / meters).cast("string"), F.floor(lon * scale / meters).cast("string"))
    near = F.lit(True) if accuracy is None else F.coalesce(accuracy <= worst, F.lit(False))
    return F.when(lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & near, key)


def set_fingerprint(names: Column) -> Column:
    """The distinct trimmed names that aren't empty, sorted and joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != ""))), "|")


def reuse_context(rows: DataFrame, minutes: int = 60) -> DataFrame:
    """Adds `reused`: the last earlier context with the same place within `minutes`, for rows without one of their own.

    An as-of join on one table: the newest row with a context is carried forward in a window, and its age is checked.
    """
    w = Window.partitionBy("device", "place").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("context").isNotNull(), F.struct("ts", "context")), ignorenulls=True).over(w)
    fresh = seconds_between(F.col("_l.ts"), F.col("ts")) <= minutes * 60
    return rows.withColumn("_l", last).withColumn("reused", F.when(F.col("context").isNull() & fresh, F.col("_l.context"))).drop("_l")


def _contain(a: str | None, b: str | None) -> bool:
    return a == b if a is None or b is None else a.lower() in b.lower() or b.lower() in a.lower()


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of windows that come sorted; one open segment is carried from batch to batch."""
    held, schema = None, None
    for b in batches:
        out, schema = [], b.schema
        for row in b.to_pylist():
            same = held is not None and all(held[c] == row[c] for c in ("device", "day", "motion"))
            if same and _contain(held["place"], row["place"]):
                held["end"] = row["end"]
                if held["place"] is None or len(row["place"]) >= len(held["place"]):
                    held["place"] = row["place"]
                continue
            if held is not None:
                out.append(held)
            held = row
        yield pa.RecordBatch.from_pylist(out, schema)
    if held is not None:
        yield pa.RecordBatch.from_pylist([held], schema)


def refine_segments(windows: DataFrame) -> DataFrame:
    """Neighbouring windows (device, day, start, end, motion, place) folded where the motion is equal and one place contains the other.

    The longer place stays; equal missing places are one. A device's day is read once in order, in linear time, with only
    the open segment held.
    """
    keys = ["device", "day", "start", "end", "motion", "place"]
    rows = windows.select(keys)
    return rows.repartition("device", "day").sortWithinPartitions(*keys).mapInArrow(_folded, rows.schema)


def unchanged(periods: DataFrame) -> DataFrame:
    """Adds `changed`: whether a period's fingerprint differs from that of the one before."""
    before = F.lag("fingerprint").over(Window.partitionBy("device").orderBy("start"))
    return periods.withColumn("changed", ~before.eqNullSafe(F.col("fingerprint")))


def idle_runs(rows: DataFrame) -> DataFrame:
    """Runs of equal signatures in a row: (device, start, end, signature, length)."""
    w = Window.partitionBy("device").orderBy("ts", "seq")
    r = rows.withColumn("_new", (~F.lag("signature").over(w).eqNullSafe(F.col("signature"))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    return r.groupBy("device", "_run", "signature").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("length")).drop("_run")


def pair_on_off(rows: DataFrame, now: Column) -> DataFrame:
    """Intervals from a screen-off to the next screen-on of (device, ts, seq, off); the last off wins, an open one ends `now`."""
    w = Window.partitionBy("device").orderBy("ts", "seq")
    r = rows.withColumn("_off", F.lead("off").over(w)).withColumn("_ts", F.lead("ts").over(w))
    r = r.where(F.col("off") & (F.col("_off").isNull() | ~F.col("_off")))
    return r.select("device", F.col("ts").alias("start"), F.coalesce("_ts", now).alias("end"), "lux").where("end > start")


def night_episode(pairs: DataFrame, events: DataFrame, least_minutes: int = 60, dark: float = 20.0) -> DataFrame:
    """(device, day, start, end, hours, coverage): the longest dark screen-off stretch of each night [day before 19:00, day 12:00), any where none is dark.

    Coverage is the part of the night between its first and its last screen event of `events` (device, ts); where the
    night has none, the part that the stretch takes.
    """
    days = F.explode(F.sequence(F.to_date("start"), F.date_add(F.to_date("end"), 1)))
    p = pairs.withColumn("day", days).withColumn("lo", F.col("day").cast("timestamp_ntz") - F.expr("INTERVAL 5 HOURS")).withColumn("hi", F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS"))
    p = p.withColumn("start", F.greatest("start", "lo")).withColumn("end", F.least("end", "hi")).withColumn("secs", seconds_between(F.col("start"), F.col("end"))).where(F.col("secs") >= least_minutes * 60)
    bright = (F.coalesce("lux", F.lit(0.0)) >= dark).cast("int")
    best = Window.partitionBy("device", "day").orderBy(bright, F.col("secs").desc(), "start")
    night = p.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    late = F.col("ts") + F.expr("INTERVAL 5 HOURS")  # a night is the first 17 hours of such a day
    seen = events.where(F.hour(late) < 17).groupBy("device", F.to_date(late).alias("day")).agg(seconds_between(F.min("ts"), F.max("ts")).alias("_seen"))
    covered = F.least(F.coalesce("_seen", "secs") / (17 * 3600), F.lit(1.0))
    return night.join(seen, ["device", "day"], "left").select("device", "day", "start", "end", (F.col("secs") / 3600).alias("hours"), covered.alias("coverage"))


def onset_regularity(nights: DataFrame) -> DataFrame:
    """100 * (1 - sigma / 4) of a device's onset hours, within 0 and 100; null below two nights."""
    hour = F.hour("start") + F.minute("start") / 60
    s = nights.groupBy("device").agg(F.count(F.lit(1)).alias("nights"), F.stddev_pop(hour).alias("sigma"))
    return s.select("device", "nights", F.when(F.col("nights") >= 2, clip(100 * (1 - F.col("sigma") / 4), 0.0, 100.0)).alias("regularity"))


def comm_counts(messages: DataFrame, sources: tuple[str, ...] = ("sms", "call")) -> DataFrame:
    """(device, day, incoming, outgoing, coverage) of messages (device, ts, source, out): coverage is the share of `sources` that were seen."""
    seen = F.count_distinct(F.when(F.col("source").isin(*sources), F.col("source"))) / len(sources)
    return messages.groupBy("device", F.to_date("ts").alias("day")).agg(F.count_if(~F.col("out")).alias("incoming"), F.count_if("out").alias("outgoing"), seen.alias("coverage"))


def screen_days(rows: DataFrame, cap_minutes: int = 60, late_from: int = 23, late_to: int = 4, full_hours: float = 16.0) -> DataFrame:
    """(device, day, total_screen_min, late_night_screen_min, coverage) of foreground switches (device, ts, seq, package).

    A switch lasts until the next one, `cap_minutes` at most, and is cut at midnight; late are its minutes before `late_to` and
    from `late_from`. Coverage is the span from the day's first to its last evidence over `full_hours`, 1 at most.
    """
    w = Window.partitionBy("device").orderBy("ts", "seq")
    end = F.least(F.coalesce(F.lead("ts").over(w), F.col("ts")), F.col("ts") + F.expr(f"INTERVAL {cap_minutes} MINUTES"))
    r = rows.withColumn("_e", end).withColumn("day", F.explode(F.sequence(F.to_date("ts"), F.to_date("_e"))))
    at = lambda hours: F.col("day").cast("timestamp_ntz") + F.expr(f"INTERVAL {hours} HOURS")
    part = lambda lo, hi: F.greatest(seconds_between(F.greatest("ts", at(lo)), F.least("_e", at(hi))), F.lit(0))
    r = r.select("device", "day", part(0, 24).alias("_all"), (part(0, late_to) + part(late_from, 24)).alias("_late"), F.greatest("ts", at(0)).alias("_s"), F.least("_e", at(24)).alias("_e"))
    d = r.groupBy("device", "day").agg((F.sum("_all") / 60).alias("total_screen_min"), (F.sum("_late") / 60).alias("late_night_screen_min"), seconds_between(F.min("_s"), F.max("_e")).alias("_span"))
    return d.select("device", "day", "total_screen_min", "late_night_screen_min", F.least(F.col("_span") / (full_hours * 3600), F.lit(1.0)).alias("coverage"))


def app_dwell(rows: DataFrame, cap_minutes: int = 60) -> DataFrame:
    """Seconds in front of each (device, day, package) until the next switch, and the switches."""
    w = Window.partitionBy("device").orderBy("ts", "seq")
    end = F.least(F.coalesce(F.lead("ts").over(w), F.col("ts")), F.col("ts") + F.expr(f"INTERVAL {cap_minutes} MINUTES"))
    r = rows.withColumn("secs", seconds_between(F.col("ts"), end)).withColumn("switch", (~F.lag("package").over(w).eqNullSafe(F.col("package"))).cast("int"))
    return r.groupBy("device", F.to_date("ts").alias("day"), "package").agg(F.sum("secs").alias("secs"), F.sum("switch").alias("switches"))


def first_active_rhythm(rows: DataFrame, days: int = 7) -> DataFrame:
    """First active hour from 04:00 of each day, and 1 - |difference| / 3 from the upper median of the days before."""
    a = rows.where((F.hour("ts") >= 4) & (F.col("motion") != "stationary")).groupBy("device", F.to_date("ts").alias("day")).agg(F.min(F.hour("ts") + F.minute("ts") / 60).alias("hour"))
    w = Window.partitionBy("device").orderBy(F.datediff("day", F.lit("1970-01-01").cast("date"))).rangeBetween(-days, -1)
    a = a.withColumn("_h", F.array_sort(F.collect_list("hour").over(w)))
    middle = F.get("_h", F.floor(F.size("_h") / 2).cast("int"))
    return a.select("device", "day", "hour", F.when(F.size("_h") > 0, clip(1 - F.abs(F.col("hour") - middle) / 3, 0.0, 1.0)).alias("rhythm"))


def battery_runs(runs: DataFrame) -> DataFrame:
    """Adds drain per hour (a run counts for a minute at least, a rise as no drop) and the warnings of a run."""
    drop = F.greatest(F.col("start_level") - F.col("end_level"), F.lit(0))
    hours = F.greatest(F.col("minutes"), F.lit(1)) / 60
    r = runs.withColumn("drop", drop).withColumn("per_hour", F.col("drop") / hours)
    return r.withColumn("warnings", F.array_compact(F.array(F.when(F.col("minutes") < 30, "short"), F.when(F.col("end_level") > F.col("start_level"), "charging"), F.when(F.col("start_level") < 50, "low start"))))


def battery_pairs(runs: DataFrame, within: int = 15, primary: int = 30) -> DataFrame:
    """One row for each platform: its newest baseline and active run compared, or else its newest run alone, with the level of drain.

    Two runs are comparable when their minutes differ by at most `within`; `delta` is the active one's drain per hour less the
    baseline's. A platform without a comparable pair has `paired` false, no delta, and the level of its newest run.
    `confidence` of a pair is 'full' when both its runs took `primary` minutes or more, else 'short'.
    """
    newest = lambda of: F.max_by(F.struct("per_hour", "minutes"), F.when(of, F.col("place")))
    last = runs.groupBy("platform").agg(newest(F.col("profile") == "baseline").alias("b"), newest(F.col("profile") == "active").alias("a"), newest(F.lit(True)).alias("any"))
    paired = F.coalesce(F.abs(F.col("a.minutes") - F.col("b.minutes")) <= within, F.lit(False))
    d = last.select("platform", paired.alias("paired"), F.when(paired, F.col("a.per_hour") - F.col("b.per_hour")).alias("delta"), F.col("any.per_hour").alias("single"), F.when(paired, F.when(F.least("a.minutes", "b.minutes") >= primary, "full").otherwise("short")).alias("confidence"))
    # fixed values: percent per hour of a difference and of a single run
    graded = lambda x, low, high: F.when(x <= low, "minimal").when(x <= high, "modest").otherwise("notable")
    return d.select("platform", "paired", "delta", F.when(F.col("paired"), graded(F.col("delta"), 2, 5)).otherwise(graded(F.col("single"), 4, 8)).alias("level"), "confidence")


def battery_impact(pairs: DataFrame) -> DataFrame:
    """One row (platforms, level): the worst level of the paired platforms, of all where none is paired; unknown without a run."""
    rank = F.when(F.col("level") == "notable", 3).when(F.col("level") == "modest", 2).otherwise(1)
    s = pairs.agg(F.count(F.lit(1)).alias("platforms"), F.max(F.when(F.col("paired"), rank)).alias("p"), F.max(rank).alias("a"))
    worst = F.coalesce("p", "a")
    return s.select("platforms", F.when(worst == 3, "notable").when(worst == 2, "modest").when(worst == 1, "minimal").otherwise("unknown").alias("level"))


def map_label(tags: Column) -> Column:
    """What a map feature with these tags (a map of texts) is; null for none of registry.MAP_LABELS."""
    out = F.lit(None).cast("string")
    for key, values, label in reversed(registry.MAP_LABELS):
        value = F.trim(F.try_element_at(tags, F.lit(key)))
        out = F.when(value.isin(values) if values else value != "", label).otherwise(out)
    return out


def feature_summary(features: DataFrame, keys: list[str], most_labels: int = 8, most_names: int = 4) -> DataFrame:
    """(keys, summary): the first distinct labels and names of features (keys, place, tags) in order of place, as one text.

    Labels and names are reduced to their first place before they are listed, so a list holds distinct ones only.
    Keys without label or name have no row.
    """
    each = F.explode(F.array(F.struct(F.lit("label").alias("kind"), map_label(F.col("tags")).alias("text")), F.struct(F.lit("name").alias("kind"), F.try_element_at("tags", F.lit("name")).alias("text"))))
    f = features.select(*keys, "place", each.alias("e")).select(*keys, "place", "e.*").where("trim(text) <> ''")
    f = f.groupBy(*keys, "kind", "text").agg(F.min("place").alias("place"))
    f = f.withColumn("n", F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("place", "text"))).where((F.col("n") <= most_names) | ((F.col("kind") == "label") & (F.col("n") <= most_labels)))
    listed = lambda kind, head: F.when(F.count_if(F.col("kind") == kind) > 0, F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("n", "text"))))["text"], ", ")))
    return f.groupBy(*keys).agg(F.concat_ws(". ", listed("label", "Nearby map features: "), listed("name", "Named places/features: ")).alias("summary"))


def recent_motion(rows: DataFrame, n: int = 10) -> DataFrame:
    """The last `n` detections of each device, oldest first, as text."""
    r = rows.withColumn("_n", F.row_number().over(Window.partitionBy("device").orderBy(F.col("ts").desc(), F.col("seq").desc()))).where(F.col("_n") <= n)
    return r.groupBy("device").agg(F.array_join(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("o"), "motion")))["motion"], ",").alias("motions"))


def marker_days(contexts: DataFrame, nights: DataFrame, comm: DataFrame, screen: DataFrame | None = None, full_hours: float = 12.0) -> DataFrame:
    """(device, day, markers, coverage): a device's days assembled from its logs, each marker with its coverage.

    `contexts` (device, day, place, secs, active_hour) give entropy, the share of the three longest places and the
    nearness of the first active hour to the device's upper median; `nights` (night_episode) give onset and duration with
    the night's coverage, and the regularity of the device's onsets, covered by the share of the device's days that have a
    night; `comm` (comm_counts) gives reciprocity with its coverage and `screen` (screen_days) the screen minutes. Days of
    any table count; a marker without its source is null with coverage 0.
    """
    stay = contexts.groupBy("device", "day", "place").agg(F.sum(F.greatest("secs", F.lit(0))).cast("double").alias("s"), F.min("active_hour").alias("hour"))
    part = F.when(F.col("s") > 0, F.col("s") * F.ln("s")).otherwise(0.0)
    longest = F.slice(F.sort_array(F.collect_list("s"), asc=False), 1, 3)
    day = stay.groupBy("device", "day").agg(F.sum("s").alias("total"), F.sum(part).alias("sls"), F.aggregate(longest, F.lit(0.0), lambda a, x: a + x).alias("top"), F.min("hour").alias("hour"))
    # the upper median by rank within the device: a window spills, a list of all days would not
    ranked = day.where("hour is not null").select("device", "hour", F.row_number().over(Window.partitionBy("device").orderBy("hour")).alias("_r"), F.count(F.lit(1)).over(Window.partitionBy("device")).alias("_c"))
    day = day.join(ranked.where("_r = floor(_c / 2) + 1").select("device", F.col("hour").alias("usual")), "device", "left")
    some = F.col("total") > 0
    seen = F.when(some, F.least(F.col("total") / (full_hours * 3600), F.lit(1.0))).otherwise(0.0)
    day = day.select("device", "day", seen.alias("seen"), F.when(some, F.ln("total") - F.col("sls") / F.col("total")).alias("mobility_entropy"), F.when(some, F.col("top") / F.col("total")).alias("location_revisit_ratio"), clip(1 - F.abs(F.col("hour") - F.col("usual")) / 3, 0.0, 1.0).alias("social_rhythm_metric"))
    onset = F.hour("start") + F.minute("start") / 60
    night = nights.select("device", "day", F.when(onset < 12, onset + 24).otherwise(onset).alias("sleep_onset_hour"), F.col("hours").alias("sleep_duration_hours"), F.col("coverage").alias("slept"))
    night = night.join(onset_regularity(nights).select("device", "nights", F.col("regularity").alias("sleep_regularity_index")), "device", "left")
    both = F.col("incoming") + F.col("outgoing")
    talk = comm.select("device", "day", F.when(both > 0, F.col("outgoing") / both).alias("comm_reciprocity"), F.col("coverage").alias("talked"))
    d = day.join(night, ["device", "day"], "full").join(talk, ["device", "day"], "full")
    if screen is None:
        d = d.select("*", *[F.lit(None).cast("double").alias(c) for c in ("total_screen_min", "late_night_screen_min", "screened")])
    else:
        d = d.join(screen.select("device", "day", "total_screen_min", "late_night_screen_min", F.col("coverage").alias("screened")), ["device", "day"], "full")
    d = d.withColumn("regular", F.least(F.col("nights") / F.count(F.lit(1)).over(Window.partitionBy("device")), F.lit(1.0)))
    cover = {"mobility_entropy": F.coalesce("seen", F.lit(0.0)), "location_revisit_ratio": F.coalesce("seen", F.lit(0.0)), "social_rhythm_metric": F.coalesce("seen", F.lit(0.0)), **{m: F.coalesce("screened", F.lit(0.0)) for m in ("total_screen_min", "late_night_screen_min")}}
    cover |= {m: F.coalesce(c, F.lit(0.0)) for m, c in (("sleep_onset_hour", "slept"), ("sleep_duration_hours", "slept"), ("sleep_regularity_index", "regular"), ("comm_reciprocity", "talked"))}
    pairs = lambda f: F.create_map(*[x for m in cover for x in (F.lit(m), f(m))])
    return d.select("device", "day", pairs(F.col).alias("markers"), pairs(lambda m: F.when(F.col(m).isNotNull(), cover[m]).otherwise(0.0)).alias("coverage"))
