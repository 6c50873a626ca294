"""Queries of the device-log operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayline.functions import registry
from dayline.operators import device as D
from dayline.plans.fixtures import events, table, with_

r6 = lambda *cs: [F.round(c, 6).alias(c) for c in cs]


def _samples(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return e.select(F.col("pid").alias("device"), "ts", F.col("event_id").alias("seq"), F.col("k").alias("steps"), (F.col("value") / 100).alias("accel"), (F.col("k") / 20).alias("speed"), F.pmod("value", F.lit(5.0)).alias("altitude"), "kind", "k", "value", "day")


def _windows(spark, d):
    return D.window_features(_samples(spark, d), "1 hour")


def q_window_features(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d).select("device", F.col("start").cast("timestamp_ntz").alias("start"), "steps", *r6("accel", "altitude_delta", "speed"))


def _motion(spark, d):
    return _windows(spark, d).withColumn("motions", D.motion_candidates(F.col("steps") * 5, F.col("accel"), F.col("altitude_delta"), F.col("speed")))


def q_motion_candidates(spark: SparkSession, d: str) -> DataFrame:
    m = _samples(spark, d).withColumn("motions", D.motion_candidates(F.col("k") * 2, F.round("accel", 6), F.round(F.col("altitude") - 2, 6), F.col("speed")))
    return m.select("device", "seq", F.array_join("motions", ",").alias("motions"))


def q_grid_key(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d).select("seq", D.grid_key(F.col("k") / 3 - 15, F.round("value", 2)).alias("grid"))


def q_usable_grid_key(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the positions that are accurate to 50 meters; others, and those of unknown accuracy, have none."""
    accuracy = F.when(F.col("k") % 11 > 0, F.pmod("value", F.lit(100.0)))
    return _samples(spark, d).select("seq", D.grid_key(F.col("k") / 3 - 15, F.round("value", 2), accuracy=F.when(F.col("k") % 13 == 0, float("nan")).otherwise(accuracy)).alias("grid"))


def q_set_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.md5(D.set_fingerprint(F.split("text", " ")).cast("binary")).alias("fingerprint"))


def q_context_reuse(spark: SparkSession, d: str) -> DataFrame:
    s = _samples(spark, d).select("device", "ts", "seq", (F.col("k") % 3).alias("place"), F.when(F.col("kind") == "view", F.concat(F.lit("c"), F.col("k").cast("string"))).alias("context"))
    return D.reuse_context(s, 24 * 60).select("seq", "reused")


def _tags(spark, d):
    """Map features: one for each sample, whose kind and number give its tags."""
    k = F.col("k")
    tags = [F.when(F.col("kind") == kind, F.create_map(F.lit("name"), F.when(k % 4 == 0, F.concat(F.lit("N"), (k % 9).cast("string"))), F.lit(key), F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int")))) for kind, (key, values) in TAGS.items()]
    return _samples(spark, d).select("device", "day", F.struct("ts", "seq").alias("place"), F.coalesce(*tags).alias("tags"))


TAGS = {
    "view": ("amenity", ["cafe", "library", "parking", "bench", "school", "gym"]),
    "click": ("leisure", ["park", "track", "swimming_pool"]),
    "purchase": ("landuse", ["retail", "residential", "meadow", "forest"]),
    "signup": ("building", ["yes", "", "house"]),
    "error": ("highway", ["footway", "primary"]),
}


def q_feature_summary(spark: SparkSession, d: str) -> DataFrame:
    """What lies around a device on each day."""
    return D.feature_summary(_tags(spark, d), ["device", "day"])


def segment_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of five minutes with a motion and a place."""
    return _samples(spark, d).select("device", "day", F.col("ts").alias("start"), F.timestamp_add("MINUTE", F.lit(5), F.col("ts")).alias("end"), F.when(F.col("k") < 70, "still").otherwise("walk").alias("motion"), F.when(F.col("k") % 3 == 0, "Cafe").when(F.col("k") % 3 == 1, "Cafe North").otherwise("Library").alias("place"))


def q_refine_segments(spark: SparkSession, d: str) -> DataFrame:
    return D.refine_segments(segment_windows(spark, d))


def q_unchanged_periods(spark: SparkSession, d: str) -> DataFrame:
    p = _samples(spark, d).groupBy("device", "day").agg(F.max("kind").alias("fingerprint")).withColumn("start", F.col("day"))
    return D.unchanged(p).select("device", "day", "changed")


def q_idle_runs(spark: SparkSession, d: str) -> DataFrame:
    return D.idle_runs(_samples(spark, d).withColumn("signature", (F.col("k") < 60).cast("string")))


def _pairs(spark, d):
    s = _samples(spark, d).select("device", "ts", "seq", (F.col("kind") == "view").alias("off"), F.col("k").cast("double").alias("lux"))
    return D.pair_on_off(s, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


def q_pair_on_off(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


def _nights(spark: SparkSession, d: str) -> DataFrame:
    return D.night_episode(_pairs(spark, d), _samples(spark, d).select("device", "ts"))


def q_night_episode(spark: SparkSession, d: str) -> DataFrame:
    return _nights(spark, d).select("device", "day", "start", "end", *r6("hours"), F.round(F.col("coverage") + 1e-10, 6).alias("coverage"))


def q_onset_regularity(spark: SparkSession, d: str) -> DataFrame:
    return D.onset_regularity(_nights(spark, d)).select("device", "nights", *r6("regularity"))


def q_app_dwell(spark: SparkSession, d: str) -> DataFrame:
    return D.app_dwell(_samples(spark, d).withColumnRenamed("kind", "package"))


def q_comm_counts(spark: SparkSession, d: str) -> DataFrame:
    s = _samples(spark, d).where("kind in ('click', 'purchase')").withColumn("source", F.when(F.col("kind") == "click", "sms").otherwise("call"))
    return D.comm_counts(s.withColumn("out", F.col("k") % 2 == 1))


def q_screen_days(spark: SparkSession, d: str) -> DataFrame:
    return D.screen_days(_samples(spark, d)).select("device", "day", *r6("total_screen_min", "late_night_screen_min"), F.round(F.col("coverage") + 1e-10, 6).alias("coverage"))


def q_first_active_rhythm(spark: SparkSession, d: str) -> DataFrame:
    s = _samples(spark, d).withColumn("motion", F.when(F.col("k") < 30, "stationary").otherwise("walking"))
    return D.first_active_rhythm(s).select("device", "day", *r6("hour", "rhythm"))


def q_context_dwell(spark: SparkSession, d: str) -> DataFrame:
    key = F.coalesce(F.when(F.col("k") % 3 == 0, F.concat(F.lit("grid"), (F.col("k") % 7).cast("string"))), F.when(F.col("k") % 3 == 1, F.lit("ssid")), F.lit("unknown"))
    return _samples(spark, d).groupBy("device", "day", key.alias("place")).agg(F.count(F.lit(1)).alias("windows"))


def _runs(spark, d):
    e = _samples(spark, d).where("kind in ('view', 'click')")
    return D.battery_runs(e.select((F.col("device") % 3).alias("platform"), F.when(F.col("kind") == "view", "baseline").otherwise("active").alias("profile"), (80 + F.col("k") % 20).alias("start_level"), (80 + F.col("k") % 20 - F.col("k") % 12 + 1).alias("end_level"), (20 + F.col("k") % 60).alias("minutes"), F.col("seq").alias("place")))


def q_battery_runs(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("place", "drop", *r6("per_hour"), F.array_join("warnings", ",").alias("warnings"))


def q_battery_pairs(spark: SparkSession, d: str) -> DataFrame:
    return D.battery_pairs(_runs(spark, d)).select("platform", "paired", *r6("delta"), "level", "confidence")


def q_battery_impact(spark: SparkSession, d: str) -> DataFrame:
    return D.battery_impact(D.battery_pairs(_runs(spark, d)))


def q_recent_motion(spark: SparkSession, d: str) -> DataFrame:
    return D.recent_motion(_samples(spark, d).withColumnRenamed("kind", "motion"))


def q_device_marker_days(spark: SparkSession, d: str) -> DataFrame:
    s = _samples(spark, d)
    hour = F.when((F.hour("ts") >= 4) & (F.col("k") >= 30), F.hour("ts") + F.minute("ts") / 60)
    contexts = s.select("device", "day", (F.col("k") % 7).alias("place"), (F.col("k") * 60).alias("secs"), hour.alias("active_hour"))
    m = D.marker_days(contexts, _nights(spark, d), q_comm_counts(spark, d), D.screen_days(s))
    return m.select("device", "day", F.explode("markers").alias("marker", "value"), "coverage").select("device", "day", "marker", F.round("value", 6).alias("value"), F.round(F.col("coverage")[F.col("marker")] + 1e-10, 6).alias("coverage"))


QUERIES = {k[2:]: v for k, v in globals().items() if k.startswith("q_")}

_PAIRS = "pairs as (select device, ts as start, coalesce(nt, timestamp '2024-02-01') as e, lux from (select pid as device, ts, kind = 'view' as off, k::double as lux, lead(kind = 'view') over w as no, lead(ts) over w as nt from ev window w as (partition by pid order by ts, event_id)) where off and (no is null or not no) and coalesce(nt, timestamp '2024-02-01') > ts)"
_NIGHT = _PAIRS + ", seen as (select pid as device, (ts + interval 5 hours)::date as day, date_sub('second', min(ts), max(ts)) as seen from ev where hour(ts + interval 5 hours) < 17 group by all), n0 as (select device, lux, unnest(generate_series(start::date::timestamp, e::date + interval 1 day, interval 1 day))::date as day, start, e from pairs), n1 as (select device, day, lux, greatest(start, day - interval 5 hours) as start, least(e, day + interval 12 hours) as e from n0), night as (select device, day, start, e, date_sub('second', start, e) / 3600.0::double as hours, least(coalesce(seen, date_sub('second', start, e)) / 61200.0::double, 1) as cov from (select *, row_number() over (partition by device, day order by (coalesce(lux, 0) >= 20)::int, date_sub('second', start, e) desc, start) as rn from n1 where date_sub('second', start, e) >= 3600) left join seen using (device, day) where rn = 1)"
_MOT = """list_filter([case when s <= 2 and a <= 0.1 and abs(c) <= 0.1 and v <= 0.1 then 'stationary' end, case when s >= 140 and v between 2 and 5 then 'jogging/running' end, case when s >= 50 and v < 1.8 then 'walking' end, case when s >= 50 and v >= 4 then 'cycling' end,
  case when (s <= 10 and v > 2) or v > 5 then 'vehicle/subway/ferry/train' end, case when s <= 10 and c > 2.5 and v < 2 then 'escalator/elevator' end, case when s <= 10 and abs(c) <= 1 and v < 0.5 then 'limited motion' end], lambda x: x is not null)"""
_E = lambda q, names=("ev",): with_(list(names), q)
_X = lambda extra, q: "with ev as (select user_id as pid, ts, ts::date as day, event_type as kind, value, (props->>'$.k')::int as k, event_id from events), " + extra + " " + q
_RUNS = "runs as (select pid % 3 as platform, case kind when 'view' then 'baseline' else 'active' end as profile, 80 + k % 20 as s, 80 + k % 20 - k % 12 + 1 as e, 20 + k % 60 as minutes, event_id as place, greatest(k % 12 - 1, 0) as drop_, greatest(k % 12 - 1, 0) / ((20 + k % 60) / 60.0::double) as per_hour from ev where kind in ('view', 'click'))"
_PAIRED = """, bp as (select platform, paired, case when paired then case when least(am, bm) >= 30 then 'full' else 'short' end end as confidence, case when paired then a - b end as delta, case when paired then case when a - b <= 2 then 'minimal' when a - b <= 5 then 'modest' else 'notable' end when one <= 4 then 'minimal' when one <= 8 then 'modest' else 'notable' end as level from (
  select *, coalesce(abs(am - bm) <= 15, false) as paired from (select platform, arg_max(per_hour, place) as one, arg_max(per_hour, place) filter (profile = 'active') as a, arg_max(minutes, place) filter (profile = 'active') as am, arg_max(per_hour, place) filter (profile = 'baseline') as b, arg_max(minutes, place) filter (profile = 'baseline') as bm from runs group by platform)))"""
_label = lambda key, value: next((label for k, values, label in registry.MAP_LABELS if k == key and (value in values if values else value)), None)
_LABELS = " ".join(f"when '{kind}' then {[_label(key, v) or '' for v in values]}[k % {len(values)} + 1]" for kind, (key, values) in TAGS.items())
SQL = {
    "window_features": _E("select pid as device, time_bucket(interval 1 hour, ts) as start, greatest(last(k order by ts, event_id) - first(k order by ts, event_id), 0) as steps, round(avg(value / 100), 6) as accel, round(last(value % 5 order by ts, event_id) - first(value % 5 order by ts, event_id), 6) as altitude_delta, round(last(k order by ts, event_id) / 20.0::double, 6) as speed from ev group by all"),
    "motion_candidates": _E(f"select device, seq, case when len(m) > 0 then array_to_string(m, ',') when s >= 50 and v >= 0.5 and v < 2 then 'walking' when s > 2 then 'limited motion' else 'stationary' end as motions from (select *, {_MOT} as m from (select pid as device, event_id as seq, k * 2 as s, round(value / 100, 6) as a, round(value % 5 - 2, 6) as c, k / 20.0::double as v from ev))"),
    "grid_key": _E("select event_id as seq, floor((k / 3.0::double - 15) * 111320.0 / 100)::bigint || ':' || floor(round(value, 2) * (111320.0 * greatest(cos(radians(k / 3.0::double - 15)), 0.1)) / 100)::bigint as grid from ev"),
    "usable_grid_key": _E("select event_id as seq, case when k % 13 > 0 and k % 11 > 0 and value % 100 <= 50 then floor((k / 3.0::double - 15) * 111320.0 / 100)::bigint || ':' || floor(round(value, 2) * (111320.0 * greatest(cos(radians(k / 3.0::double - 15)), 0.1)) / 100)::bigint end as grid from ev"),
    "set_fingerprint": "select item_id, md5(array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(text, ' '), lambda x: trim(x)), lambda x: x <> ''))), '|')) as fingerprint from benchmark",
    "context_reuse": _E("select event_id as seq, case when kind <> 'view' and date_sub('second', lt, ts) <= 86400 then lc end as reused from (select *, last_value(case when kind = 'view' then 'c' || k end ignore nulls) over w as lc, last_value(case when kind = 'view' then ts end ignore nulls) over w as lt from ev window w as (partition by pid, k % 3 order by ts, event_id rows between unbounded preceding and 1 preceding))"),
    "feature_summary": _E(f"""select device, day, concat_ws('. ', 'Nearby map features: ' || string_agg(text, ', ' order by n) filter (kind = 'label' and n <= 8), 'Named places/features: ' || string_agg(text, ', ' order by n) filter (kind = 'name' and n <= 4)) as summary from (
      select device, day, kind, text, row_number() over (partition by device, day, kind order by min(ts), arg_min(event_id, ts), text) as n from (
        select pid as device, day, ts, event_id, 'label' as kind, case kind {_LABELS} end as text from ev union all select pid, day, ts, event_id, 'name', case when k % 4 = 0 then 'N' || (k % 9) end from ev) where text <> '' group by device, day, kind, text) group by device, day"""),
    "unchanged_periods": _E("select device, day, lag(f) over (partition by device order by day) is distinct from f as changed from (select pid as device, day, max(kind) as f from ev group by all)"),
    "idle_runs": _E("""select device, signature, min(ts) as start, max(ts) as "end", count(*) as length from (select *, sum(n) over (partition by device order by ts, event_id rows unbounded preceding) as r from (select pid as device, ts, event_id, (k < 60)::varchar as signature, (lag((k < 60)) over (partition by pid order by ts, event_id) is distinct from (k < 60))::int as n from ev)) group by device, r, signature"""),
    "pair_on_off": _X(_PAIRS, 'select device, start, e as "end", lux from pairs'),
    "night_episode": _X(_NIGHT, 'select device, day, start, e as "end", round(hours, 6) as hours, round(cov + 1e-10, 6) as coverage from night'),
    "onset_regularity": _X(_NIGHT, "select device, count(*) as nights, case when count(*) >= 2 then round(greatest(0, least(100, 100 * (1 - stddev_pop(hour(start) + minute(start) / 60.0::double) / 4))), 6) end as regularity from night group by device"),
    "app_dwell": _E("select device, day, kind as package, sum(secs)::bigint as secs, sum(sw)::bigint as switches from (select pid as device, day, kind, date_sub('second', ts, least(coalesce(lead(ts) over w, ts), ts + interval 60 minutes)) as secs, (lag(kind) over w is distinct from kind)::int as sw from ev window w as (partition by pid order by ts, event_id)) group by all"),
    "comm_counts": _E("select pid as device, day, count(*) filter (k % 2 = 0) as incoming, count(*) filter (k % 2 = 1) as outgoing, count(distinct kind) / 2.0::double as coverage from ev where kind in ('click', 'purchase') group by all"),
    "screen_days": _E("""select device, day, round(sum(t) / 60.0::double, 6) as total_screen_min, round(sum(greatest(date_sub('second', s, least(e, day + interval 4 hours)), 0) + greatest(date_sub('second', greatest(s, day + interval 23 hours), e), 0)) / 60.0::double, 6) as late_night_screen_min, round(least(date_sub('second', min(s), max(e)) / 57600.0::double, 1) + 1e-10, 6)::double as coverage
      from (select *, date_sub('second', s, e) as t from (select device, day, greatest(ts, day::timestamp) as s, least(e, day + interval 24 hours) as e from (select device, ts, e, unnest(generate_series(ts::date::timestamp, e::date::timestamp, interval 1 day))::date as day from (select pid as device, ts, least(coalesce(lead(ts) over (partition by pid order by ts, event_id), ts), ts + interval 60 minutes) as e from ev)))) group by all"""),
    "refine_segments": _E("""select device, day, min(start) as start, arg_max("end", rn) as "end", any_value(motion) as motion, arg_max(place, rn) as place from rec group by device, day, seg""", ("ev", )).replace("select device, day, min(start)", """, w as (select *, row_number() over (partition by device, day order by start, "end", motion, place) as rn from (select pid as device, day, ts as start, ts + interval 5 minutes as "end", case when k < 70 then 'still' else 'walk' end as motion, case k % 3 when 0 then 'Cafe' when 1 then 'Cafe North' else 'Library' end as place from ev)),
      rec as (select device, day, rn, 1 as seg, start, "end", motion, place from w where rn = 1 union all select device, day, rn, case when fits then seg else seg + 1 end, start, "end", motion, case when fits and length(was) > length(place) then was else place end from (
        select w.*, rec.seg, rec.place as was, rec.motion = w.motion and (contains(lower(rec.place), lower(w.place)) or contains(lower(w.place), lower(rec.place))) as fits from rec join w on w.device = rec.device and w.day = rec.day and w.rn = rec.rn + 1)) select device, day, min(start)""").replace("with ev", "with recursive ev", 1),
    "first_active_rhythm": _E("select device, day, round(h, 6) as hour, case when len(hs) > 0 then round(greatest(0, least(1, 1 - abs(h - list_sort(hs)[len(hs) // 2 + 1]) / 3)), 6) end as rhythm from (select *, coalesce(list(h) over (partition by device order by (day - date '1970-01-01') range between 7 preceding and 1 preceding), []) as hs from (select pid as device, day, min(hour(ts) + minute(ts) / 60.0::double) as h from ev where hour(ts) >= 4 and k >= 30 group by all))"),
    "context_dwell": _E("select pid as device, day, case k % 3 when 0 then 'grid' || (k % 7) when 1 then 'ssid' else 'unknown' end as place, count(*) as windows from ev group by all"),
    "battery_runs": _X(_RUNS, "select place, drop_ as drop, round(per_hour, 6) as per_hour, array_to_string(list_filter([case when minutes < 30 then 'short' end, case when e > s then 'charging' end, case when s < 50 then 'low start' end], lambda x: x is not null), ',') as warnings from runs"),
    "battery_pairs": _X(_RUNS + _PAIRED, "select platform, paired, round(delta, 6) as delta, level, confidence from bp"),
    "battery_impact": _X(_RUNS + _PAIRED, "select count(*) as platforms, coalesce(['minimal', 'modest', 'notable'][coalesce(max(r) filter (paired), max(r))], 'unknown') as level from (select *, case level when 'notable' then 3 when 'modest' then 2 else 1 end as r from bp)"),
    "recent_motion": _E("select device, string_agg(kind, ',' order by n desc) as motions from (select pid as device, kind, row_number() over (partition by pid order by ts desc, event_id desc) as n from ev) where n <= 10 group by device"),
    "device_marker_days": _X(_NIGHT, """, st as (select pid as device, day, k % 7 as place, sum(k * 60)::double as s, min(case when hour(ts) >= 4 and k >= 30 then hour(ts) + minute(ts) / 60.0::double end) as h from ev group by all),
      d0 as (select device, day, sum(s) as total, sum(case when s > 0 then s * ln(s) else 0 end) as sls, list_sum(list_sort(list(s), 'DESC')[1:3]) as top, min(h) as h from st group by device, day),
      us as (select device, list_sort(list(h) filter (h is not null)) as hs from d0 group by device),
      dd as (select device, day, case when total > 0 then least(total / 43200, 1) else 0 end as seen, case when total > 0 then ln(total) - sls / total end as me, case when total > 0 then top / total end as lr, case when h is not null then greatest(0, least(1, 1 - abs(h - hs[len(hs) // 2 + 1]) / 3)) end as sr from d0 join us using (device)),
      ng as (select device, day, hour(start) + minute(start) / 60.0::double + case when hour(start) < 12 then 24 else 0 end as onset, hours, cov from night),
      cm as (select pid as device, day, count(*) filter (k % 2 = 1) / count(*)::double as cr, count(distinct kind) / 2.0::double as talked from ev where kind in ('click', 'purchase') group by all),
      rg as (select device, count(*) as nights, case when count(*) >= 2 then greatest(0, least(100, 100 * (1 - stddev_pop(hour(start) + minute(start) / 60.0::double) / 4))) end as reg from night group by device),
      sd as (select device, day, sum(t) / 60.0::double as ts_, sum(greatest(date_sub('second', s, least(e, day + interval 4 hours)), 0) + greatest(date_sub('second', greatest(s, day + interval 23 hours), e), 0)) / 60.0::double as ls_, least(date_sub('second', min(s), max(e)) / 57600.0::double, 1) as sc
        from (select *, date_sub('second', s, e) as t from (select device, day, greatest(ts, day::timestamp) as s, least(e, day + interval 24 hours) as e from (select device, ts, e, unnest(generate_series(ts::date::timestamp, e::date::timestamp, interval 1 day))::date as day from (select pid as device, ts, least(coalesce(lead(ts) over (partition by pid order by ts, event_id), ts), ts + interval 60 minutes) as e from ev)))) group by all),
      al as (select *, least(nights / count(*) over (partition by device)::double, 1) as regular from dd full join (select * from ng left join rg using (device)) using (device, day) full join cm using (device, day) full join sd using (device, day))
      select device, day, m.marker, round(m.v, 6) as value, round(case when m.v is null then 0 else m.c end + 1e-10, 6)::double as coverage from (select device, day, unnest([{'marker': 'mobility_entropy', 'v': me::double, 'c': coalesce(seen, 0)::double}, {'marker': 'location_revisit_ratio', 'v': lr, 'c': coalesce(seen, 0)}, {'marker': 'social_rhythm_metric', 'v': sr, 'c': coalesce(seen, 0)}, {'marker': 'total_screen_min', 'v': ts_, 'c': coalesce(sc, 0)}, {'marker': 'late_night_screen_min', 'v': ls_, 'c': coalesce(sc, 0)}, {'marker': 'sleep_regularity_index', 'v': reg, 'c': coalesce(regular, 0)}, {'marker': 'sleep_onset_hour', 'v': onset, 'c': coalesce(cov, 0)}, {'marker': 'sleep_duration_hours', 'v': hours, 'c': coalesce(cov, 0)}, {'marker': 'comm_reciprocity', 'v': cr, 'c': coalesce(talked, 0)}]) as m from al)"""),
}
