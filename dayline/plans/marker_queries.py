"""Queries of the marker operators, from raw streams to marker days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayline.functions import registry
from dayline.functions.columns import behavioural_day, seconds_between
from dayline.operators import markers as M
from dayline.operators.intervals import clip_intervals, day_windows, intersect_intervals, merge_intervals
from dayline.plans.fixtures import apps, comm, dark, events, locations, locked, with_

MIN = 2  # samples: a user day has 2.5 events on average
r6 = lambda *cs: [F.round(c, 6).alias(c) for c in cs]


def _spine(spark: SparkSession, d: str) -> DataFrame:
    e, k = events(spark, d), locked(spark, d)
    return M.day_spine(e.select("pid", F.col("ts").alias("first"), F.col("ts").alias("last")).unionByName(k.select("pid", F.col("start").alias("first"), F.col("end").alias("last"))))


def q_day_spine(spark: SparkSession, d: str) -> DataFrame:
    return _spine(spark, d)


def q_day_assign(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("pid", behavioural_day(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def q_interval_clip(spark: SparkSession, d: str) -> DataFrame:
    c = clip_intervals(locked(spark, d), day_windows(_spine(spark, d), "4 hours", "28 hours"))
    return c.groupBy("pid", "day").agg(F.count(F.lit(1)).alias("n"), F.sum(seconds_between(F.col("start"), F.col("end"))).alias("secs"))


def q_merge_intervals(spark: SparkSession, d: str) -> DataFrame:
    return merge_intervals(locked(spark, d), ["pid"])


def q_interval_intersect(spark: SparkSession, d: str) -> DataFrame:
    w = day_windows(_spine(spark, d), "-4 hours", "11 hours")
    a, b = clip_intervals(locked(spark, d), w), clip_intervals(dark(spark, d), w)
    return intersect_intervals(a.select("pid", "day", "start", "end"), b, ["pid", "day"]).groupBy("pid", "day").agg(F.sum(seconds_between(F.col("start"), F.col("end"))).alias("secs"))


def _sleep(spark: SparkSession, d: str) -> DataFrame:
    return M.sleep_episodes(locked(spark, d), dark(spark, d), _spine(spark, d))


def q_sleep_episode(spark: SparkSession, d: str) -> DataFrame:
    return _sleep(spark, d).select("pid", "day", "start", "end", *r6("onset", "duration"))


def q_sleep_regularity(spark: SparkSession, d: str) -> DataFrame:
    return M.sleep_regularity(_sleep(spark, d), _spine(spark, d)).select("pid", "day", *r6("sri", "coverage"))


def q_total_screen(spark: SparkSession, d: str) -> DataFrame:
    return M.screen_minutes(locked(spark, d), _spine(spark, d), "4 hours", "28 hours").select("pid", "day", *r6("minutes"))


def q_late_night_screen(spark: SparkSession, d: str) -> DataFrame:
    return M.screen_minutes(locked(spark, d), _spine(spark, d), "-1 hours", "4 hours").select("pid", "day", *r6("minutes"))


def q_screen_coverage(spark: SparkSession, d: str) -> DataFrame:
    return M.screen_minutes(locked(spark, d), _spine(spark, d), "4 hours", "28 hours").select("pid", "day", *r6("coverage"))


def q_location_dwell(spark: SparkSession, d: str) -> DataFrame:
    return M.dwell(locations(spark, d), least=MIN)


def q_mobility_entropy(spark: SparkSession, d: str) -> DataFrame:
    return M.mobility(M.dwell(locations(spark, d), least=MIN)).select("pid", "day", *r6("entropy"))


def q_revisit_ratio(spark: SparkSession, d: str) -> DataFrame:
    return M.mobility(M.dwell(locations(spark, d), least=MIN)).select("pid", "day", *r6("revisit", "coverage"))


def _switching(spark: SparkSession, d: str) -> DataFrame:
    return M.app_switching(apps(spark, d), M.screen_minutes(locked(spark, d), _spine(spark, d), "4 hours", "28 hours"), MIN)


def q_app_switching(spark: SparkSession, d: str) -> DataFrame:
    return _switching(spark, d).select("pid", "day", F.round("rate", 8).alias("rate"))


def q_comm_reciprocity(spark: SparkSession, d: str) -> DataFrame:
    return M.comm_reciprocity(comm(spark, d), MIN).select("pid", "day", *r6("reciprocity"))


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    return M.daily_anchors(locked(spark, d), locations(spark, d), comm(spark, d), "^L0$")


def q_daily_anchors(spark: SparkSession, d: str) -> DataFrame:
    return _anchors(spark, d).select("pid", "day", "anchor", *r6("hours"))


def q_social_rhythm(spark: SparkSession, d: str) -> DataFrame:
    return M.social_rhythm(_anchors(spark, d)).select("pid", "day", *r6("srm", "coverage"))


def q_raw_marker_days(spark: SparkSession, d: str) -> DataFrame:
    """All markers from the raw streams, one row a day."""
    m = M.marker_days(locked(spark, d), dark(spark, d), locations(spark, d), apps(spark, d), comm(spark, d), _spine(spark, d), "^L0$", MIN, MIN)
    return m.select("pid", "day", *r6(*[n for n in registry.NAMES if n != "app_switching_rate"]), F.round("app_switching_rate", 8).alias("app_switching_rate"))


QUERIES = {k[2:]: v for k, v in globals().items() if k.startswith("q_")}

_CTE = {
    "locked": 'select * from (select pid, ts + to_seconds(floor(value)::bigint) as s, lead(ts) over (partition by pid order by ts, event_id) as e from ev) where e > s',
    "dark": "select pid, s + interval 15 minutes as s, e - interval 15 minutes as e from locked where date_sub('second', s, e) >= 7200 and pid % 2 = 0",
    "places": "select pid, ts as time, 'L' || (k % 7) as location, event_id, (ts - interval 4 hours)::date as day from ev",
    "comm": "select pid, ts as time, (case when kind = 'click' then 1 + k % 2 else 1 + k % 3 end) = 2 as outgoing, (ts - interval 4 hours)::date as day from ev where kind in ('click', 'purchase')",
    "bounds": "select pid, min(a)::date as d0, max(b)::date as d1 from (select pid, ts as a, ts as b from ev union all select pid, s, e from locked) group by 1",
    "spine": "select pid, unnest(generate_series(d0::timestamp, d1::timestamp, interval 1 day))::date as day from bounds",
}


def _clipped(table: str, lo: str, hi: str) -> str:
    return f"select t.pid, p.day, greatest(t.s, p.day + {lo}) as s, least(t.e, p.day + {hi}) as e from {table} t join spine p on t.pid = p.pid and t.s < p.day + {hi} and t.e > p.day + {lo}"


def _merged(table: str, keys: str) -> str:
    return f"""select {keys}, min(s) as s, max(e) as e from (select *, sum(fresh) over (partition by {keys} order by s, e rows unbounded preceding) as isl from (
      select *, case when r is null or date_sub('second', r, s) > 1800 then 1 else 0 end as fresh from (
        select *, max(e) over (partition by {keys} order by s, e rows between unbounded preceding and 1 preceding) as r from {table}))) group by {keys}, isl"""


_H = lambda n: f"interval '{n} hours'"
_CTE |= {
    "gaps": "select * from (select pid, e as s, lead(s) over (partition by pid order by s, e) as e from locked) where e > s",
    "night": _clipped("locked", _H(-4), _H(11)),
    "dim": _clipped("dark", _H(-4), _H(11)),
    "whole": _merged("night", "pid, day"),
    "options": """
select w.pid, w.day, greatest(w.s, d.s) as s, least(w.e, d.e) as e, 0 as tier from whole w join dim d on w.pid = d.pid and w.day = d.day and greatest(w.s, d.s) < least(w.e, d.e)
union all select *, 0 from whole w where not exists (select 1 from dim d where d.pid = w.pid and d.day = w.day) union all select *, 1 from whole""",
    "sleep": """
select pid, day, s, e, hour(s) + minute(s) / 60.0 + case when s::date = day then 24 else 0 end as onset, date_sub('second', s, e) / 3600.0 as duration from (
  select *, row_number() over (partition by pid, day order by tier, date_sub('second', s, e) desc, s) as rn from options
  where date_sub('second', s, e) between 9000 and 43200 and s <= day + interval 4 hours) where rn = 1""",
    "mins": "select pid, day, unnest(range(-360, 720)) as m, floor(date_sub('second', day::timestamp, s) / 60.0) as a, floor(date_sub('second', day::timestamp, e) / 60.0) as b from sleep",
    "state": "select pid, day, m, (m >= a and m < b)::int as asleep from mins",
    "pairs": "select x.pid, case when x.m < 0 then x.day - 1 else x.day end as day, count(*) as known, sum((x.asleep <> y.asleep)::int) as differ from state x join state y on x.pid = y.pid and x.day = y.day + 1 and x.m = y.m group by all",
    "total": f"select s.pid, s.day, coalesce(m, 0) as m, coalesce(c, 0) as c from spine s left join (select pid, day, sum(date_sub('second', s, e)) / 60.0 as m from ({_clipped('gaps', _H(4), _H(28))}) group by all) g on g.pid = s.pid and g.day = s.day left join (select pid, day, date_sub('second', min(s), max(e)) / 86400.0 as c from ({_clipped('locked', _H(4), _H(28))}) group by all) k on k.pid = s.pid and k.day = s.day",
    "late": f"select s.pid, s.day, coalesce(m, 0) as m, coalesce(c, 0) as c from spine s left join (select pid, day, sum(date_sub('second', s, e)) / 60.0 as m from ({_clipped('gaps', _H(-1), _H(4))}) group by all) g on g.pid = s.pid and g.day = s.day left join (select pid, day, date_sub('second', min(s), max(e)) / 18000.0 as c from ({_clipped('locked', _H(-1), _H(4))}) group by all) k on k.pid = s.pid and k.day = s.day",
    "dwelt": "select pid, day, location, sum(secs) as secs from (select *, least(greatest(date_sub('second', time, coalesce(lead(time) over (partition by pid, day order by time, event_id), day + interval 28 hours)), 0), 1800)::double as secs, count(*) over (partition by pid, day) as n from places) where n >= 2 group by all",
    "moved": "select pid, day, -sum(case when p > 0 then p * ln(p) else 0 end) as entropy, sum(secs) filter (rn <= 3) / any_value(t) as revisit, least(1.0, any_value(t) / 43200) as coverage from (select *, secs / t as p from (select *, sum(secs) over (partition by pid, day) as t, row_number() over (partition by pid, day order by secs desc) as rn from dwelt) where t > 0) group by all",
    "touch": "select l.pid, d.day, min(l.e) as first_unlock, max(l.e) as last_unlock from locked l join (select distinct pid, unnest(generate_series(s::date - interval 1 day, e::date::timestamp, interval 1 day))::date as day from locked) d on l.pid = d.pid and l.s < d.day + interval 28 hours and l.e > d.day + interval 4 hours group by all",
    "anchors": """
select pid, day, anchor, hours from (select pid, day, anchor, date_sub('second', day + interval 4 hours, t) / 3600.0 as hours from (
  select pid, day, 'first_unlock' as anchor, first_unlock as t from touch union all select pid, day, 'last_unlock', last_unlock from touch
  union all select pid, day, 'first_outside', min(time) from places where location <> 'L0' group by pid, day union all select pid, day, 'first_comm', min(time) from comm group by pid, day)) where hours >= 0 and hours < 24""",
}


def _sql(names: list[str], q: str) -> str:
    order: list[str] = []

    def need(n: str) -> None:
        import re

        for x in _CTE:
            if x != n and re.search(rf"\b(from|join) {x}\b", _CTE[n]):
                need(x)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    return with_(["ev"], q, {n: _CTE[n] for n in order})


SQL = {
    "day_spine": _sql(["spine"], "select * from spine"),
    "day_assign": with_(["ev"], "select pid, (ts - interval 4 hours)::date as day, count(*) as n from ev group by all"),
    "interval_clip": _sql(["locked", "spine"], f"select pid, day, count(*) as n, sum(date_sub('second', s, e))::bigint as secs from ({_clipped('locked', _H(4), _H(28))}) group by all"),
    "merge_intervals": _sql(["locked"], f'select pid, s as start, e as "end" from ({_merged("locked", "pid")})'),
    "interval_intersect": _sql(["night", "dim"], "select n.pid, n.day, sum(date_sub('second', greatest(n.s, d.s), least(n.e, d.e)))::bigint as secs from night n join dim d on n.pid = d.pid and n.day = d.day and greatest(n.s, d.s) < least(n.e, d.e) group by all"),
    "sleep_episode": _sql(["sleep"], 'select pid, day, s as start, e as "end", round(onset, 6)::double as onset, round(duration, 6)::double as duration from sleep'),
    "sleep_regularity": _sql(["pairs", "spine"], """
select s.pid, s.day, case when k >= 2880 then round(100 * (1 - x / k), 6) end::double as sri, case when k >= 2880 then round(least(1.0, k / 10080.0), 6) else 0.0 end::double as coverage
from (select s.pid, s.day, coalesce(sum(known) over w, 0)::double as k, sum(differ) over w::double as x from spine s left join pairs p on p.pid = s.pid and p.day = s.day
      window w as (partition by s.pid order by (s.day - date '1970-01-01') range between 6 preceding and current row)) s"""),
    "total_screen": _sql(["total"], "select pid, day, case when c > 0 then round(m, 6) end::double as minutes from total"),
    "late_night_screen": _sql(["late"], "select pid, day, case when c > 0 then round(m, 6) end::double as minutes from late"),
    "screen_coverage": _sql(["total"], "select pid, day, round(c, 6)::double as coverage from total"),
    "location_dwell": _sql(["dwelt"], "select * from dwelt"),
    "mobility_entropy": _sql(["moved"], "select pid, day, round(entropy, 6) as entropy from moved"),
    "revisit_ratio": _sql(["moved"], "select pid, day, round(revisit, 6) as revisit, round(coverage, 6) as coverage from moved"),
    "app_switching": _sql(["total"], "select a.pid, a.day, round(sw / m::double, 8) as rate from (select pid, day, count(*) as n, count(*) filter (b <> kind) as sw from (select pid, (ts - interval 4 hours)::date as day, kind, lag(kind) over (partition by pid, (ts - interval 4 hours)::date order by ts, event_id) as b from ev) group by all) a join total t on a.pid = t.pid and a.day = t.day where n >= 2 and c > 0 and m >= 5"),
    "comm_reciprocity": _sql(["comm"], "select pid, day, round(count(*) filter (outgoing) / count(*)::double, 6) as reciprocity from comm group by all having count(*) >= 2"),
    "daily_anchors": _sql(["anchors"], "select pid, day, anchor, round(hours, 6)::double as hours from anchors"),
    "social_rhythm": _sql(["anchors"], """
select pid, day, round(hits / used::double, 6) as srm, round(least(1.0, history / 7.0), 6)::double as coverage from (
  select *, count(*) over (partition by pid order by n range between 7 preceding and 1 preceding) as history from (
    select pid, day, n, count(*) filter (held >= 3) as used, count(*) filter (held >= 3 and abs(hours - med) <= 1.5) as hits from (
      select *, count(hours) over w as held, quantile_cont(hours, 0.5) over w as med from (select *, (day - date '1970-01-01') as n from anchors)
      window w as (partition by pid, anchor order by n range between 7 preceding and 1 preceding)) group by all)) where history >= 3 and used > 0"""),
}

SQL["raw_marker_days"] = (
    "select s.pid, s.day, onset as sleep_onset_hour, duration as sleep_duration_hours, sri as sleep_regularity_index, l.minutes as late_night_screen_min, t.minutes as total_screen_min, rate as app_switching_rate, entropy as mobility_entropy, revisit as location_revisit_ratio, srm as social_rhythm_metric, reciprocity as comm_reciprocity "
    f"from ({SQL['day_spine']}) s"
    + "".join(f" left join ({SQL[q]}) {a} on {a}.pid = s.pid and {a}.day = s.day" for q, a in (("sleep_episode", "e"), ("sleep_regularity", "g"), ("late_night_screen", "l"), ("total_screen", "t"), ("app_switching", "w"), ("mobility_entropy", "n"), ("revisit_ratio", "r"), ("social_rhythm", "y"), ("comm_reciprocity", "c")))
)
