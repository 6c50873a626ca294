"""Calendar merging, conflicts, free slots and proposals. Overlaps meet on (pid, day), never in a theta join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayline.functions.columns import seconds_between

MINUTE = "INTERVAL 1 MINUTE"


def normalise_events(events: DataFrame) -> DataFrame:
    """Start and end as times (all-day dates begin at midnight), titles and privacy with defaults."""
    return events.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz")).withColumn("title", F.coalesce("title", F.lit("Untitled"))).withColumn("private", F.coalesce("private", F.lit(False)))


def merge_calendars(events: DataFrame, start: Column, end: Column) -> DataFrame:
    """Events that touch [start, end), without private ones, one for each id (the earliest); null ids all stay."""
    e = normalise_events(events).where((F.col("start") < end) & (F.col("end") > start) & ~F.col("private"))
    first = F.row_number().over(Window.partitionBy("pid", "id").orderBy("start", "calendar"))
    return e.withColumn("_n", F.when(F.col("id").isNull(), 1).otherwise(first)).where("_n = 1").drop("_n")


def schedule_summary(events: DataFrame) -> DataFrame:
    """Events, hours, days covered and the busiest day (the first of equals) of each pid."""
    day = F.to_date("start")
    per = events.groupBy("pid", day.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(seconds_between(F.col("start"), F.col("end")) / 3600).alias("h"))
    best = F.max_by("day", F.struct(F.col("n"), -F.datediff("day", F.lit("1970-01-01").cast("date"))))
    return per.groupBy("pid").agg(F.sum("n").alias("event_count"), F.round(F.sum("h"), 1).alias("total_hours"), best.alias("busiest_day"), F.count(F.lit(1)).alias("days_covered"))


def schedule_tasks(tasks: DataFrame, most: int = 10) -> DataFrame:
    """(pid, task_count, tasks): the number of a pid's tasks (pid, id, title, due, list) and the `most` due first, as text; undated ones come last."""
    w = Window.partitionBy("pid")
    t = tasks.withColumn("_n", F.row_number().over(w.orderBy(F.col("due").asc_nulls_last(), "id"))).withColumn("_c", F.count(F.lit(1)).over(w)).where(F.col("_n") <= most)
    line = F.concat(F.coalesce("title", F.lit("Untitled")), F.lit(" ("), F.coalesce(F.date_format("due", "yyyy-MM-dd"), F.lit("No due date")), F.lit(", "), F.coalesce("list", F.lit("")), F.lit(")"))
    return t.groupBy("pid").agg(F.max("_c").alias("task_count"), F.array_join(F.sort_array(F.collect_list(F.struct("_n", line.alias("t"))))["t"], "; ").alias("tasks"))


def busy_slots(events: DataFrame) -> DataFrame:
    """(pid, day, slots): the day's events in order as text."""
    slot = F.struct("start", F.concat(F.date_format("start", "HH:mm"), F.lit("-"), F.date_format("end", "HH:mm"), F.lit(" "), F.col("title")).alias("text"))
    return events.groupBy("pid", F.to_date("start").alias("day")).agg(F.array_join(F.sort_array(F.collect_list(slot))["text"], "; ").alias("slots"))


def _touched(df: DataFrame) -> DataFrame:
    return df.withColumn("_day", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))))


def conflicts(proposals: DataFrame, events: DataFrame) -> DataFrame:
    """Proposals (pid, pkey, start, end) that overlap an event by more than a minute, or whose times can't be read."""
    e = _touched(events.select("pid", "start", "end")).select(F.col("pid").alias("_pid"), F.col("_day").alias("_eday"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    p = _touched(proposals.where("start is not null and end is not null"))
    hit = (F.col("pid") == F.col("_pid")) & (F.col("_day") == F.col("_eday")) & (F.col("start") < F.col("_e") - F.expr(MINUTE)) & (F.col("_s") < F.col("end") - F.expr(MINUTE))
    return p.join(e, hit, "left_semi").select("pkey").distinct().unionByName(proposals.where("start is null or end is null").select("pkey"))


def drop_conflicts(proposals: DataFrame, events: DataFrame) -> DataFrame:
    """Proposals to add that don't conflict; any other action is dropped too."""
    add = proposals.where("action = 'add'")
    return add.join(conflicts(add, events), "pkey", "left_anti")


def with_free_day(slots: DataFrame, events: DataFrame, days: int = 7) -> DataFrame:
    """Slots (skey, pid, today, minute, minutes) with `free_day`, the first of the next `days` days whose slot is free, else the next one.

    Slots and events meet in blocks of days + 1 days, two for most slots, and a pair tells all days on which it conflicts:
    no slot is multiplied by its days.
    """
    block = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / (days + 1))
    blocks = lambda first, last: F.explode(F.sequence(block(first), block(last))).alias("_block")
    at = lambda offset: F.timestamp_add("MINUTE", F.col("minute"), F.date_add("today", offset).cast("timestamp_ntz"))
    until = lambda offset: F.timestamp_add("MINUTE", F.col("minutes"), at(offset))
    s = slots.select("skey", "pid", "today", "minute", "minutes", blocks(F.to_date(at(F.lit(1))), F.to_date(until(F.lit(days)))))
    e = events.select("pid", F.col("start").alias("_s"), F.col("end").alias("_e"), blocks(F.to_date("start"), F.to_date("end")))
    busy = F.filter(F.sequence(F.lit(1), F.lit(days)), lambda o: (at(o) < F.col("_e") - F.expr(MINUTE)) & (F.col("_s") < until(o) - F.expr(MINUTE)))
    taken = s.join(e, ["pid", "_block"]).select("skey", F.explode(busy).alias("offset")).groupBy("skey").agg(F.collect_set("offset").alias("_busy"))
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.lit(days)), F.coalesce("_busy", F.array().cast("array<int>"))))
    return slots.join(taken, "skey", "left").withColumn("free_day", F.date_add("today", F.coalesce(free, F.lit(1)))).drop("_busy")


def first_free_day(slots: DataFrame, events: DataFrame, days: int = 7) -> DataFrame:
    """(skey, free_day) of `with_free_day`."""
    return with_free_day(slots, events, days).select("skey", "free_day")


def dedupe_key(title: Column, start: Column) -> Column:
    squashed = F.substring(F.trim(F.regexp_replace(F.lower(title), r"\s+", " ")), 1, 48)
    return F.concat(squashed, F.lit("|"), F.substring(start, 1, 16))


def dedupe_proposals(proposals: DataFrame) -> DataFrame:
    """The first proposal (by place) of each pid and key."""
    key = dedupe_key(F.col("title"), F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss"))
    p = proposals.withColumn("key", key)
    return p.withColumn("_n", F.row_number().over(Window.partitionBy("pid", "key").orderBy("place"))).where("_n = 1").drop("_n")


def proposal_outcomes(proposals: DataFrame, applied: DataFrame) -> DataFrame:
    """accepted where the normalised title was applied by the same pid, else rejected."""
    norm = lambda c: F.lower(F.trim(c))
    a = applied.select("pid", norm(F.col("title")).alias("_t")).distinct().withColumn("_ok", F.lit(True))
    p = proposals.withColumn("_t", norm(F.col("title"))).join(a, ["pid", "_t"], "left")
    return p.withColumn("outcome", F.when(F.col("_ok"), "accepted").otherwise("rejected")).drop("_t", "_ok")


def day_pressure(events: DataFrame) -> DataFrame:
    """Hours and counts of each day with events (pid, start, end, fixed, exam), and whether an exam is within two days."""
    h = seconds_between(F.col("start"), F.col("end")) / 3600
    d = events.groupBy("pid", F.to_date("start").alias("day")).agg(
        F.sum(F.when(F.col("fixed"), h).otherwise(0.0)).alias("fixed_hours"), F.sum(F.when(~F.col("fixed"), h).otherwise(0.0)).alias("flex_hours"), F.sum(F.when(~F.col("fixed") & (F.hour("start") >= 20), h).otherwise(0.0)).alias("late_flex_hours"),
        F.count_if("fixed").alias("fixed_count"), F.count(F.lit(1)).alias("event_count"), F.max("exam").alias("exam_today"),
    )
    near = Window.partitionBy("pid").orderBy(F.datediff("day", F.lit("1970-01-01").cast("date"))).rangeBetween(-2, 2)
    return d.withColumn("exam_near", F.max("exam_today").over(near))


def calendar_window(decisions: DataFrame, events: DataFrame, days: int = 7) -> DataFrame:
    """(pid, day, n, titles): the events of the `days` days from each decision day on, in order."""
    d = decisions.select("pid", "day").distinct().withColumn("_day", F.explode(F.sequence(F.col("day"), F.date_add("day", days - 1))))
    e = events.select("pid", F.to_date("start").alias("_day"), "start", "title")
    return d.join(e, ["pid", "_day"]).groupBy("pid", "day").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list(F.struct("start", "title")))["title"], ", ").alias("titles"))
