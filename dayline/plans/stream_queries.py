"""Streaming jobs replayed over the given tables, each beside the SQL of its batch twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayline.operators import baseline as B
from dayline.plans import device_queries, marker_queries, pipeline_queries
from dayline.plans.fixtures import events, locked, marker_long, table, with_
from dayline.plans.pipeline_queries import N, R
from dayline.streaming import jobs
from dayline.streaming.replay import arrival, replay, replay_batches

#: Three steps of arrival.
BOUNDS = ["2024-01-11", "2024-01-21"]
STEPS = len(BOUNDS) + 1
#: How late rows may come in the replays that have late rows.
LATE_DAYS = 3
#: Gap that ends a session; screens are on for minutes between locks here.
GAP_SECONDS = 120

ntz = lambda *cs: [F.col(c).cast("timestamp_ntz").alias(c) for c in cs]


def _events(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))


def _in_utc(query):
    """Registered queries cast local times of the tables in UTC, whatever zone the session has."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        before = spark.conf.get("spark.sql.session.timeZone")
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        try:
            return query(spark, d)
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)

    return run


def _delayed(step: Column, late: Column) -> Column:
    """A step later where `late` holds, but in the last step."""
    return F.when(late & (step < STEPS - 1), step + 1).otherwise(step)


def q_stream_days(spark: SparkSession, d: str) -> DataFrame:
    """Behavioural days of events that arrive in order."""
    out = replay(_events(spark, d).select("pid", "ts", "value"), arrival(F.col("ts"), BOUNDS), STEPS, jobs.behavioural_days, "stream-days")
    return out.select("pid", "day", "n", F.round("total", 6).alias("total"))


def q_stream_late_days(spark: SparkSession, d: str) -> DataFrame:
    """Behavioural days where every tenth event comes a step late: it counts if its day is still open, else it is dropped."""
    rows = _events(spark, d).select("pid", "ts", "value", "event_id")
    step = _delayed(arrival(F.col("ts"), BOUNDS), F.col("event_id") % 10 == 0)
    out = replay(rows, step, STEPS, lambda s: jobs.behavioural_days(s, f"{LATE_DAYS} days"), "stream-late-days")
    return out.select("pid", "day", "n", F.round("total", 6).alias("total"))


def q_stream_sensor_windows(spark: SparkSession, d: str) -> DataFrame:
    samples = device_queries._samples(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = replay(samples.select("device", "ts", "seq", "steps", "accel", "speed", "altitude"), arrival(F.col("ts"), BOUNDS), STEPS, lambda s: jobs.sensor_windows(s, length="1 hour"), "stream-sensors")
    return out.select("device", *ntz("start"), "steps", *[F.round(c, 6).alias(c) for c in ("accel", "altitude_delta", "speed")])


def q_stream_weekly_means(spark: SparkSession, d: str) -> DataFrame:
    out = replay(_events(spark, d).select("pid", "ts", "value"), arrival(F.col("ts"), BOUNDS), STEPS, jobs.weekly_means, "stream-weeks")
    return out.select("pid", "before", F.round("mean", 6).alias("mean"), "days")


def q_stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = locked(spark, d).select("pid", F.col("start").cast("timestamp").alias("start"), F.col("end").cast("timestamp").alias("end"))
    out = replay(rows, arrival(F.col("start"), BOUNDS), STEPS, lambda s: jobs.merged_sessions(s, GAP_SECONDS), "stream-sessions")
    return out.select("pid", *ntz("first", "last"))


def q_stream_journals(spark: SparkSession, d: str) -> DataFrame:
    """Journals stored once for each id, though repeats come days after the watermark has passed the first."""
    c = table(spark, d, "conversations")
    ts = F.timestamp_add("HOUR", (F.col("conv_id") * 7 + F.col("turn")) % 720, F.lit("2024-01-01").cast("timestamp"))
    rows = c.select((F.col("conv_id") % 50).alias("user"), F.when(F.col("turn") % 5 > 0, F.col("turn") % 3).alias("journal_id"), ts.alias("ts"), (F.col("conv_id") * 1000 + F.col("turn")).alias("place"))
    store = replay_batches(rows, arrival(F.col("ts"), BOUNDS), STEPS, lambda s: s, jobs.journal_ingest, "stream-journals")
    return jobs.stored_journals(spark, store, rows).select("user", "journal_id", "place")


def q_stream_on_off(spark: SparkSession, d: str) -> DataFrame:
    s = device_queries._samples(spark, d).select("device", F.col("ts").cast("timestamp").alias("ts"), "seq", (F.col("kind") == "view").alias("off"), F.col("k").cast("double").alias("lux"))
    out = replay(s, arrival(F.col("ts"), BOUNDS), STEPS, jobs.pair_on_off, "stream-on-off")
    return out.select("device", *ntz("start", "end"), "lux")


def q_stream_changed_periods(spark: SparkSession, d: str) -> DataFrame:
    """Changed fingerprints, though the last two days of each step arrive a step late for odd devices."""
    s = device_queries._samples(spark, d).groupBy("device", "day").agg(F.max("kind").alias("fingerprint"), F.min("ts").cast("timestamp").alias("ts")).select("device", "ts", "fingerprint")
    step, soon = arrival(F.col("ts"), BOUNDS), arrival(F.col("ts") + F.expr("INTERVAL 2 DAYS"), BOUNDS)
    out = replay(s, F.when(F.col("device") % 2 == 1, F.greatest(step, soon)).otherwise(step), STEPS, lambda x: jobs.changed_periods(x, f"{LATE_DAYS} days", 365), "stream-changed")
    return out.select("device", *ntz("ts"), "fingerprint")


def q_stream_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of the days that the watermark has closed; odd devices' windows of the last hours of a step arrive a step late."""
    s = device_queries.segment_windows(spark, d)
    s = s.select("device", F.col("start").cast("timestamp").alias("ts"), F.col("end").cast("timestamp").alias("end"), "motion", "place")
    step, soon = arrival(F.col("ts"), BOUNDS), arrival(F.col("ts") + F.expr("INTERVAL 10 HOURS"), BOUNDS)
    out = replay(s, F.when(F.col("device") % 2 == 1, F.greatest(step, soon)).otherwise(step), STEPS, lambda x: jobs.refined_segments(x, "12 hours"), "stream-segments")
    last = s.agg(F.to_date(F.max("ts") - F.expr("INTERVAL 12 HOURS")).alias("last"))  # one row
    return out.join(F.broadcast(last), F.col("day") < F.col("last")).select("device", "day", *ntz("start", "end"), "motion", "place")


def q_stream_deviations(spark: SparkSession, d: str) -> DataFrame:
    """Deviations kept up to date while days arrive, a fifth of the people's a step late."""
    long = marker_long(spark, d)
    step = _delayed(arrival(F.col("day").cast("timestamp"), BOUNDS), (F.col("pid") % 5 == 0) & (F.dayofmonth("day") % 3 == 0))
    store = replay_batches(long, step, STEPS, lambda s: s, lambda folder: jobs.deviation_ingest(folder, lambda h: B.deviations(h, R, N), R + N - 1), "stream-deviations")
    out = jobs.current_deviations(spark, store)
    return out.select("pid", "day", "marker", "magnitude", "trajectory", "direction", "coverage", *[F.round(c, 6).alias(c) for c in ("recent_mean", "baseline_mean", "baseline_std")], F.col("recent_days").cast("long").alias("recent_days"))


QUERIES = {k[2:]: _in_utc(v) for k, v in globals().items() if k.startswith("q_")}

_STEP = lambda ts: f"(({ts} >= timestamp '{BOUNDS[0]}')::int + ({ts} >= timestamp '{BOUNDS[1]}')::int)"
_E = lambda q, extra: with_(["ev"], q, extra)
_SEG = device_queries.SQL["refine_segments"]
SQL = {
    "stream_days": _E("select pid, day, count(*) as n, round(sum(value), 6) as total from d, w where day + interval 28 hours <= last - interval 2 hours group by all", {"d": "select pid, (ts - interval 4 hours)::date as day, value from ev", "w": "select max(ts) as last from ev"}),
    # a row is dropped when its day had ended by the watermark that the steps before its own left behind
    "stream_late_days": _E(
        f"select d.pid, day, count(*) as n, round(sum(value), 6) as total from d join marks m on m.step = d.step, w where coalesce(day + interval 28 hours > m.mark, true) and day + interval 28 hours <= last - interval {LATE_DAYS} days group by all",
        {
            "s": f"select pid, ts, value, least({_STEP('ts')} + (event_id % 10 = 0)::int, {STEPS - 1}) as step from ev",
            "d": "select *, (ts - interval 4 hours)::date as day from s",
            "marks": f"select step, (select max(ts) from s where s.step < n.step) - interval {LATE_DAYS} days as mark from (select unnest(range({STEPS})) as step) n",
            "w": "select max(ts) as last from ev",
        },
    ),
    "stream_sensor_windows": f"select * from ({device_queries.SQL['window_features']}) where start + interval 1 hour <= (select max(ts) from events) - interval 1 minute",
    "stream_weekly_means": _E(
        "select pid, before, round(avg(total), 6) as mean, count(*) as days from (select *, unnest(generate_series(day + interval 1 day, day + interval 7 days, interval 1 day))::date as before from t) , w where before <= last - interval 2 hours group by all",
        {"t": "select pid, day, sum(value) as total from ev group by all", "w": "select max(ts) as last from ev"},
    ),
    "stream_sessions": _E(
        f"select pid, min(s) as first, max(e) as last from (select *, sum(fresh) over (partition by pid order by s, e rows unbounded preceding) as isl from o) group by pid, isl having max(e) + interval {GAP_SECONDS} seconds <= (select max(s) from locked) - interval 1 day",
        {
            "locked": marker_queries._CTE["locked"],
            "o": f"select *, coalesce((r + interval {GAP_SECONDS} seconds < s)::int, 1) as fresh from (select *, max(e) over (partition by pid order by s, e rows between unbounded preceding and 1 preceding) as r from locked)",
        },
    ),
    "stream_journals": """
with j as (select conv_id % 50 as user, case when turn % 5 > 0 then turn % 3 end as journal_id, timestamp '2024-01-01' + to_hours((conv_id * 7 + turn) % 720) as ts, conv_id * 1000 + turn as place from conversations)
select user, journal_id, place from (select *, row_number() over (partition by user, journal_id order by ts, place) as n from j) where n = 1 or journal_id is null""",
    "stream_on_off": _E(
        """select device, ts as start, least(nt, ts + interval 24 hours) as "end", lux from n, w where off and (nt is null and ts + interval 24 hours <= mark or nt is not null and (nt <= mark or ts + interval 24 hours <= mark) and (not no or nt >= ts + interval 24 hours))""",
        {"n": "select pid as device, ts, kind = 'view' as off, k::double as lux, lead(ts) over x as nt, lead(kind = 'view') over x as no from ev window x as (partition by pid order by ts, event_id)", "w": "select max(ts) - interval 10 minutes as mark from ev"},
    ),
    "stream_changed_periods": _E(
        f"select device, ts, fingerprint from (select *, lag(fingerprint) over (partition by device order by ts) is distinct from fingerprint as changed from p), w where changed and ts <= last - interval {LATE_DAYS} days",
        {"p": "select pid as device, day, max(kind) as fingerprint, min(ts) as ts from ev group by all", "w": "select max(ts) as last from p"},
    ),
    "stream_segments": f"select * from ({_SEG}) where day < ((select max(ts) from events) - interval 12 hours)::date",
    "stream_deviations": pipeline_queries.SQL["deviations"],
}
