"""Logical tables over the given tables, in Spark and in SQL: the rules of FIXTURES.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayline.functions import registry
from dayline.operators import baseline


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, ts, day, kind, value, k."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("pid"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.to_date("ts").alias("day"), F.col("event_type").alias("kind"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"), "event_id")


def marker_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simple wide marker table with a coverage map."""
    e = events(spark, sf_dir)
    kinds = e.groupBy("pid", "day", "kind").agg(F.count(F.lit(1)).alias("c"), F.sum("value").alias("v"), F.sum(F.when((F.hour("ts") >= 23) | (F.hour("ts") < 4), F.col("value")).otherwise(0.0)).alias("late"), F.sum("k").alias("sk"), F.sum(F.col("k").cast("double") * F.col("k")).alias("skk"), F.count_if(F.col("k") < 50).alias("few"))
    d = kinds.groupBy("pid", "day").agg(
        F.sum("v").alias("total_screen_min"), F.sum("late").alias("late_night_screen_min"), F.sum("c").alias("n"), F.sum("sk").alias("sk"), F.sum("skk").alias("skk"), F.sum("few").alias("few"),
        F.sum(F.col("c") * F.ln("c")).alias("clnc"), F.max("c").alias("most"), F.coalesce(F.sum(F.when(F.col("kind") == "purchase", F.col("c"))), F.lit(0)).alias("out"), F.coalesce(F.sum(F.when(F.col("kind") == "signup", F.col("c"))), F.lit(0)).alias("inc"),
    )
    n, mean = F.col("n"), F.col("sk") / F.col("n")
    d = d.select(
        "pid", "day", (20 + mean / 20).alias("sleep_onset_hour"), (4 + mean / 20).alias("sleep_duration_hours"), (100 - F.sqrt(F.greatest(F.col("skk") / n - mean * mean, F.lit(0.0)))).alias("sleep_regularity_index"),
        "late_night_screen_min", "total_screen_min", n.cast("double").alias("app_switching_rate"), (F.ln(n) - F.col("clnc") / n).alias("mobility_entropy"), (F.col("most") / n).alias("location_revisit_ratio"),
        (F.col("few") / n).alias("social_rhythm_metric"), F.when(F.col("out") + F.col("inc") > 0, F.col("out") / (F.col("out") + F.col("inc"))).alias("comm_reciprocity"), F.least(F.lit(1.0), n / 4).alias("c"),
    )
    pairs = [x for m in registry.NAMES for x in (F.lit(m), F.when(F.col(m).isNull(), 0.0).otherwise(F.col("c")))]
    return d.withColumn("coverage", F.create_map(*pairs)).drop("c")


def marker_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long marker days; values rounded to 9 places, so that both engines see the same ones."""
    wide = marker_days(spark, sf_dir)
    return baseline.to_long(wide.select("pid", "day", "coverage", *[F.round(m, 9).alias(m) for m in registry.NAMES]))


def locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("pid").orderBy("ts", "event_id")
    e = events(spark, sf_dir).withColumn("end", F.lead("ts").over(w)).withColumn("start", F.timestamp_add("SECOND", F.floor("value").cast("int"), F.col("ts")))
    return e.where("end > start").select("pid", "start", "end")


def dark(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = locked(spark, sf_dir).where((F.timestamp_diff("SECOND", F.col("start"), F.col("end")) >= 7200) & (F.col("pid") % 2 == 0))
    return long.select("pid", (F.col("start") + F.expr("INTERVAL 15 MINUTES")).alias("start"), (F.col("end") - F.expr("INTERVAL 15 MINUTES")).alias("end"))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("pid", F.col("ts").alias("time"), F.concat(F.lit("L"), (F.col("k") % 7).cast("string")).alias("location"), "event_id")


def apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("pid", F.col("ts").alias("time"), F.col("kind").alias("package"), "event_id")


def comm(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("kind in ('click', 'purchase')")
    code = F.when(F.col("kind") == "click", 1 + F.col("k") % 2).otherwise(1 + F.col("k") % 3)
    return e.select("pid", F.col("ts").alias("time"), (code == 2).alias("outgoing"), F.when(F.col("kind") == "click", "sms").otherwise("call").alias("channel"))


_MARKERS = ", ".join(f"('{m}', {i}, '{d}', {s})" for i, (m, d, s) in enumerate(registry.MARKERS))
_RULES = ", ".join(f"('{p}', {registry.PATTERNS.index(p)}, {i}, '{m}', '{d}', {'true' if r else 'false'})" for i, (p, m, d, r) in enumerate(registry.RULES))

#: Common table expressions by name; WITH_ puts those that a query needs in front of it.
CTE = {
    "ev": "select user_id as pid, ts, ts::date as day, event_type as kind, value, (props->>'$.k')::int as k, event_id from events",
    "kinds": "select pid, day, kind, count(*)::double as c from ev group by all",
    "shape": "select pid, day, ln(sum(c)) - sum(c * ln(c)) / sum(c) as ent, max(c) / sum(c) as top from kinds group by all",
    "spec": f"select * from (values {_MARKERS}) t(marker, position, domain, least_std)",
    "rules": f"select * from (values {_RULES}) t(pattern, pattern_position, position, marker, direction, required)",
}
CTE["wide"] = """
select e.pid, e.day, 20 + avg(k) / 20 as sleep_onset_hour, 4 + avg(k) / 20 as sleep_duration_hours, 100 - stddev_pop(k) as sleep_regularity_index,
  sum(case when hour(ts) >= 23 or hour(ts) < 4 then value else 0.0 end) as late_night_screen_min, sum(value) as total_screen_min,
  count(*)::double as app_switching_rate, any_value(ent) as mobility_entropy, any_value(top) as location_revisit_ratio,
  avg((k < 50)::int) as social_rhythm_metric,
  count(*) filter (kind = 'purchase') / nullif(count(*) filter (kind in ('purchase', 'signup')), 0)::double as comm_reciprocity,
  least(1.0, count(*) / 4.0)::double as c
from ev e join shape s on e.pid = s.pid and e.day = s.day group by e.pid, e.day"""
CTE["long"] = "select pid, day, (day - date '1970-01-01')::int as day_num, marker, value, case when value is null then 0.0 else c end as coverage from (" + " union all ".join(f"select pid, day, '{m}' as marker, round({m}, 9) as value, c from wide" for m in registry.NAMES) + ")"
CTE["usable"] = "select *, case when coverage >= 0.5 then value end as v from long"


def framed(first: int, last: int) -> str:
    return f"(partition by pid, marker order by day_num range between {-first} preceding and {f'{-last} preceding' if last < 0 else 'current row'})"


def stats_sql(first: int, last: int) -> str:
    w = framed(first, last)
    return f"""
select *, greatest(pop_std, mad_std, least_std) as std from (
  select b.*, s.least_std, s.position, s.domain,
    1.4826 * list_aggregate(list_transform(vs, lambda x: abs(x - median)), 'median') as mad_std
  from (
    select *, case when n0 >= 3 then n0 end as n, case when n0 >= 3 then m0 end as mean, case when n0 >= 3 then s0 end as pop_std, case when n0 >= 3 then q50 end as median,
           case when n0 >= 3 then q20 end as p20, case when n0 >= 3 then q80 end as p80, case when n0 >= 3 then l0 end as low, case when n0 >= 3 then h0 end as high,
           case when n0 >= 3 then list_filter(l, lambda x: x is not null) end as vs
    from (select *, count(v) over w as n0, avg(v) over w as m0, stddev_pop(v) over w as s0, quantile_cont(v, 0.5) over w as q50, quantile_cont(v, 0.2) over w as q20,
                 quantile_cont(v, 0.8) over w as q80, min(v) over w as l0, max(v) over w as h0, list(v) over w as l from usable window w as {w})) b
  join spec s on b.marker = s.marker)"""


def hour_sql(x: str) -> str:
    """HH:MM of an hour of day."""
    return f"(lpad(((floor({x})::int + case when round_even(({x} - floor({x})) * 60, 0) = 60 then 1 else 0 end) % 24)::varchar, 2, '0') || ':' || lpad((round_even(({x} - floor({x})) * 60, 0)::int % 60)::varchar, 2, '0'))"


def quality_sql(average: str) -> str:
    return f"case when {average} >= 0.75 then 'high' when {average} >= 0.45 then 'medium' when {average} > 0 then 'low' else 'none' end"


MAGNITUDE_SQL = "case when abs(z) < 1.0 then 'within-typical' when abs(z) < 1.8 then 'mild' when abs(z) < 2.8 then 'moderate' else 'pronounced' end"
RANK_SQL = "case magnitude when 'within-typical' then 0 when 'mild' then 1 when 'moderate' then 2 else 3 end"
TRAJECTORY_SQL = """
case when n = 0 then 'no-data' when e = 0 then 'within-typical' when n = 1 then 'acute-1d'
     when e = n and one then 'sustained-' || n || 'd'
     when n >= 3 and one and grow and abs(zs[n]) >= 1 then 'drift-emerging-' || n || 'd'
     when abs(zs[n]) >= 1 and e = 1 then 'acute-1d' else 'intermittent-' || e || 'd-of-' || n end"""


def deviations_sql(recent: int, base: int, least: int = 1) -> str:
    w = framed(-(recent - 1), 0)
    return f"""
select pid, day, day_num, marker, domain, position, z, {MAGNITUDE_SQL} as magnitude, {TRAJECTORY_SQL} as trajectory, case when z > 0 then 'up' else 'down' end as direction,
       coverage, recent_mean, mean as baseline_mean, std as baseline_std, n as recent_days
from (
  select *, len(zs) as n, len(list_filter(zs, lambda x: abs(x) >= 1)) as e,
    len(list_filter(zs, lambda x: x > 0)) in (0, len(zs)) as one,
    len(list_filter(range(1, len(zs)), lambda i: not abs(zs[i]) <= abs(zs[i + 1]) + 0.2)) = 0 as grow,
    round((recent_mean - mean) / std, 9) as z
  from (
    select s.pid, s.day, s.day_num, s.marker, s.domain, s.position, s.mean, s.std, r.recent_mean, {quality_sql('r.cov')} as coverage,
           list_transform(r.vs, lambda x: round((x - s.mean) / s.std, 9)) as zs
    from (select * from stats where mean is not null) s
    join (select pid, day, marker, avg(v) over w as recent_mean, list_filter(list(v) over w, lambda x: x is not null) as vs, avg(coverage) over w as cov from usable window w as {w}) r
      on s.pid = r.pid and s.day = r.day and s.marker = r.marker
    where len(r.vs) >= {max(2, recent // 2)}))
where {RANK_SQL.replace('magnitude', '(' + MAGNITUDE_SQL + ')', 1)} >= {least}"""


CTE["stats"] = stats_sql(-(4 + 21 - 1), -4)
CTE["devs"] = deviations_sql(4, 21)
CTE["pats"] = """
select pid, day, pattern, any_value(pattern_position) as pattern_position, list(marker order by position) as implicated from (
  select d.pid, d.day, r.pattern, r.pattern_position, r.position, r.marker, r.required, n.needed, sum(r.required::int) over (partition by d.pid, d.day, r.pattern) as met
  from devs d join rules r on d.marker = r.marker and d.direction = r.direction join (select pattern, sum(required::int) as needed from rules group by 1) n on n.pattern = r.pattern)
where met = needed group by pid, day, pattern"""
CTE["history"] = "select pid, day, day_num, count(*) over (partition by pid order by day rows unbounded preceding) as history from (select distinct pid, day, day_num from long)"
CTE["daily"] = f"""
select h.pid, h.day, h.day_num, history, history >= 10 as warm, present as n_markers_present,
  case when history >= 10 then coalesce(weight, 0) + 2 * coalesce(n_pat, 0) else 0 end::double as risk_index,
  case when history >= 10 then coalesce(n_dev, 0) else 0 end as n_dev, case when history >= 10 then coalesce(n_pat, 0) else 0 end as n_pat,
  case when history >= 10 then coalesce(pn, '') else '' end as pattern_names, case when history >= 10 then coalesce(dm, '') else '' end as dev_markers
from history h join (select pid, day, count(*) filter (coverage >= 0.5) as present from long group by all) m on h.pid = m.pid and h.day = m.day
left join (select pid, day, count(*) as n_dev, sum({RANK_SQL}) as weight, string_agg(marker, '|' order by position) as dm from devs group by all) d on d.pid = h.pid and d.day = h.day
left join (select pid, day, count(*) as n_pat, string_agg(pattern, '|' order by pattern_position) as pn from pats group by all) p on p.pid = h.pid and p.day = h.day"""

_NEEDS = {
    "kinds": ["ev"], "shape": ["kinds"], "wide": ["ev", "shape"], "long": ["wide"], "usable": ["long"], "stats": ["usable", "spec"], "devs": ["stats", "usable"],
    "pats": ["devs", "rules"], "history": ["long"], "daily": ["history", "devs", "pats", "long"],
}


def with_(names: list[str], query: str, extra: dict[str, str] | None = None) -> str:
    """`query` with the common table expressions it needs, in order, then those in `extra`."""
    order: list[str] = []

    def need(n: str) -> None:
        for x in _NEEDS.get(n, []):
            need(x)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    parts = [f"{n} as ({CTE[n]})" for n in order] + [f"{k} as ({v})" for k, v in (extra or {}).items()]
    return "with " + ",\n".join(parts) + "\n" + query
