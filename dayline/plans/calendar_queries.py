"""Queries of calendars, proposals and the evaluation of recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayline.functions.columns import clock
from dayline.operators import calendar as C
from dayline.operators import evaluation as E
from dayline.operators import intervals as I
from dayline.plans.fixtures import events, hour_sql, locked, table, with_

r6 = lambda *cs: [F.round(c, 6).alias(c) for c in cs]


def _calendar(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    start = F.timestamp_add("HOUR", (F.col("o_orderkey") % 24).cast("int"), F.col("o_orderdate").cast("timestamp_ntz"))
    o = o.withColumn("start", start).withColumn("end", F.timestamp_add("MINUTE", (30 * (1 + F.col("o_orderkey") % 4)).cast("int"), F.col("start")))
    return o.select(F.col("o_custkey").alias("pid"), (F.col("o_orderkey") % 5000).alias("id"), "start", "end", F.concat(F.lit("E"), F.col("o_orderkey").cast("string")).alias("title"), (F.col("o_orderstatus") == "F").alias("fixed"), (F.col("o_orderkey") % 10 == 0).alias("exam"), (F.col("o_orderkey") % 7 == 0).alias("private"), F.col("o_orderpriority").alias("calendar"), F.col("o_orderkey").alias("okey"))


def _proposals(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    start = F.timestamp_add("HOUR", (F.col("l_linenumber") * 3 % 24).cast("int"), F.col("o_orderdate").cast("timestamp_ntz"))
    l = l.withColumn("start", F.when(F.col("l_orderkey") % 11 > 0, start)).withColumn("end", F.timestamp_add("MINUTE", F.lit(30), F.col("start")))
    place = F.col("l_orderkey") * 10000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey") % 100000
    return l.select(F.col("o_custkey").alias("pid"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("pkey"), "start", "end", F.concat("l_returnflag", "l_linestatus").alias("title"), F.when(F.round("l_tax", 2) == 0, "delete").otherwise("add").alias("action"), place.alias("place"))


LO, HI = "1995-01-01", "1996-01-01"


def q_merge_calendars(spark: SparkSession, d: str) -> DataFrame:
    m = C.merge_calendars(_calendar(spark, d), F.lit(LO).cast("timestamp_ntz"), F.lit(HI).cast("timestamp_ntz"))
    return m.select("pid", "id", "start", "end", "title")


def q_schedule_summary(spark: SparkSession, d: str) -> DataFrame:
    return C.schedule_summary(_calendar(spark, d))


def q_schedule_tasks(spark: SparkSession, d: str) -> DataFrame:
    t = _calendar(spark, d).select("pid", F.col("okey").alias("id"), "title", F.when(F.col("okey") % 6 > 0, F.to_date("start")).alias("due"), F.col("calendar").alias("list"))
    return C.schedule_tasks(t)


def q_busy_slots(spark: SparkSession, d: str) -> DataFrame:
    return C.busy_slots(_calendar(spark, d))


def q_proposal_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return C.drop_conflicts(_proposals(spark, d), _calendar(spark, d)).select("pkey", "pid", "start", "title")


def _slots(spark, d):
    return _calendar(spark, d).select(F.col("okey").alias("skey"), "pid", F.to_date("start").alias("today"), ((F.col("okey") % 24) * 60).cast("int").alias("minute"), F.lit(30).alias("minutes"))


def q_first_free_slot(spark: SparkSession, d: str) -> DataFrame:
    return C.first_free_day(_slots(spark, d), _calendar(spark, d))


def q_promote_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Clock-time suggestions put on their first free day for 30 minutes, rolled past midnight; conflicts stay out."""
    s = _slots(spark, d)
    p = C.with_free_day(s, _calendar(spark, d)).withColumn("start", F.timestamp_add("MINUTE", F.col("minute"), F.col("free_day").cast("timestamp_ntz"))).withColumn("end", F.timestamp_add("MINUTE", F.lit(30), F.col("start")))
    p = p.withColumn("pkey", F.col("skey").cast("string")).withColumn("action", F.lit("add"))
    return C.drop_conflicts(p, _calendar(spark, d)).select("skey", "pid", "start", "end")


def q_dedupe_proposals(spark: SparkSession, d: str) -> DataFrame:
    p = _proposals(spark, d).where("start is not null").withColumn("title", F.concat(F.lit("  Walk   "), F.substring("title", 1, 1)))
    return C.dedupe_proposals(p).groupBy("pid", "key").agg(F.min("place").alias("place"))


def q_proposal_outcomes(spark: SparkSession, d: str) -> DataFrame:
    p = _proposals(spark, d)
    applied = p.where("title = 'NO' or title = 'AF'").select("pid", F.lower("title").alias("title")).distinct()
    return C.proposal_outcomes(p, applied).groupBy("pid", "outcome").agg(F.count(F.lit(1)).alias("n"))


def q_tz_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Positions of a person's proposals whose zone isn't the person's."""
    z = F.when(F.col("l_orderkey") % 3 == 0, "UTC").otherwise("Europe/Paris")
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pid"), "l_linenumber", z.alias("own"), F.when(F.col("l_linenumber") % 2 == 0, "UTC").otherwise("Europe/Paris").alias("zone"))
    a = p.groupBy("pid", "own").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "zone"))).alias("zs"))
    x = a.select("pid", "own", F.posexplode("zs.zone").alias("i", "zone")).where("zone <> own")
    return x.groupBy("pid").agg(F.array_join(F.sort_array(F.collect_list("i")).cast("array<string>"), ",").alias("positions"))


def q_day_pressure(spark: SparkSession, d: str) -> DataFrame:
    return C.day_pressure(_calendar(spark, d)).select("pid", "day", *r6("fixed_hours", "flex_hours", "late_flex_hours"), "fixed_count", "event_count", "exam_today", "exam_near")


def q_calendar_window(spark: SparkSession, d: str) -> DataFrame:
    c = _calendar(spark, d)
    return C.calendar_window(c.select("pid", F.to_date("start").alias("day")), c)


def _arms(spark: SparkSession, d: str) -> DataFrame:
    c = lambda x, v: F.round(x, 2) > v
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linestatus").alias("arm"), F.col("l_linenumber").alias("line"), c("l_discount", 0.04).alias("lever_pass"), c("l_tax", 0.03).alias("burden_pass"), (F.col("l_quantity") > 20).alias("specificity_pass"), (F.col("l_quantity") / 10).alias("burden"), (F.col("l_partkey") % 4).alias("pattern"), (F.col("l_suppkey") % 3 > 0).alias("detected")).withColumn("all_three", F.col("lever_pass") & F.col("burden_pass") & F.col("specificity_pass"))


PASSES = ["lever_pass", "burden_pass", "specificity_pass", "all_three"]
_WORDS = ["cancel the gym", "Move lunch", "add a walk", "cap screen time", "reschedule and shorten", "rest"]


def _suggestions(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in _WORDS])
    start = F.when(F.col("l_linenumber") % 4 > 0, clock(F.col("l_partkey") % 20))
    end = clock(F.col("l_partkey") % 20 + (F.col("l_suppkey") % 13) / 4)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("line"), F.get(words, (F.col("l_partkey") % 6).cast("int")).alias("change"), start.alias("start_time"), end.alias("end_time"))


def q_burden_score(spark: SparkSession, d: str) -> DataFrame:
    return E.burden_score(_suggestions(spark, d)).withColumn("ok", E.burden_ok(F.col("burden"), (F.col("case_id") % 10) / 10))


def q_specificity(spark: SparkSession, d: str) -> DataFrame:
    s = E.specific(F.col("change"), F.col("start_time"), F.col("end_time"), F.array(F.lit("lunch"), F.lit("gym")))
    return _suggestions(spark, d).groupBy("case_id").agg(F.max(s).alias("specific"))


def q_normalize_pattern(spark: SparkSession, d: str) -> DataFrame:
    n = F.trim(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-"), F.lit("-"))
    return table(spark, d, "part").select("p_partkey", n.alias("pattern"))


def q_evidence_type(spark: SparkSession, d: str) -> DataFrame:
    a = _arms(spark, d)
    kind = F.when(F.col("detected") & (F.col("pattern") > 0), "pattern").when(F.col("detected"), "partial_marker").otherwise("none")
    return a.groupBy(kind.alias("evidence")).agg(F.count(F.lit(1)).alias("n"))


def q_arm_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.rates(_arms(spark, d), ["arm"], PASSES).select("arm", "n", *r6(*PASSES))


def q_detection_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return E.with_total(_arms(spark, d), "pattern", ["detected"]).select("pattern", "n", *r6("detected"))


def q_conditional_quality(spark: SparkSession, d: str) -> DataFrame:
    a = _arms(spark, d)
    return E.on_cases(a, a.where("arm = 'O' and detected"), PASSES).select("arm", "n", *r6(*PASSES))


def q_restraint(spark: SparkSession, d: str) -> DataFrame:
    a = _arms(spark, d).withColumn("high_burden", F.col("burden") >= 2.5).withColumn("no_change", F.col("burden") < 0.5)
    return E.on_cases(a, a.where("pattern = 0"), ["high_burden", "no_change"]).select("arm", "n", *r6("high_burden", "no_change"))


def q_credit_decomposition(spark: SparkSession, d: str) -> DataFrame:
    return E.credit_decomposition(_arms(spark, d), "detected", "lever_pass").select("arm", "n", "n_with", *r6("rate_with", "rate_without", "rate", "reconstructed"))


def q_miss_reasons(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("burden") < 1, "no_data").when(~F.col("lever_pass"), "below_threshold").otherwise("wrong_direction")
    m = _arms(spark, d).where("not detected").withColumn("reason", reason).cube("pattern", "reason").agg(F.count(F.lit(1)).alias("n"))
    return m.select(F.coalesce(F.col("pattern").cast("string"), F.lit("all")).alias("pattern"), F.coalesce("reason", F.lit("all")).alias("reason"), "n")


def _pairs(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("aware"), F.col("o_orderpriority").alias("plain"))


def q_blind_pairs(spark: SparkSession, d: str) -> DataFrame:
    return E.blind_pairs(_pairs(spark, d))


def q_rater_summary(spark: SparkSession, d: str) -> DataFrame:
    key = E.blind_pairs(_pairs(spark, d))
    ratings = key.select("case_id", "side", (F.col("case_id") * F.when(F.col("side") == "A", 3).otherwise(5) % 5).alias("rating"))
    return E.rater_summary(ratings, key).select("arm", "n", *r6("mean_rating", "preference_rate"))


def q_suggestion_text(spark: SparkSession, d: str) -> DataFrame:
    s = _suggestions(spark, d).groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("line", "change"))).alias("s"))
    return s.select("case_id", F.md5(F.array_join(F.transform("s", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["change"])), "\n").cast("binary")).alias("digest"))


def q_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Share of cases detected by pattern and overall, with the share of people who recovered at least once."""
    a = _arms(spark, d).withColumn("person", F.col("case_id") % 500)
    once = a.groupBy("person").agg(F.max("detected").alias("once")).agg(F.round(F.avg(F.col("once").cast("int")), 6).alias("people_once"))
    return E.with_total(a, "pattern", ["detected"]).select("pattern", "n", *r6("detected")).join(F.broadcast(once))


_PATTERNS = list(E.MECHANISM)
_SAID = ["cancel the gym", "Move lunch by an hour", "add a walk", "keep a wake time", "put the phone away", "rest"]
_GROUND = ["sleep_onset_hour", "mobility_entropy", "app_switching_rate", ""]
_pick = lambda words, c: F.get(F.array(*[F.lit(w) for w in words]), c.cast("int"))


def q_fixed_protection(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), _pick(_SAID, F.col("l_partkey") % 6).alias("text"))
    said = said.groupBy("case_id").agg(F.array_join(F.sort_array(F.collect_list("text")), "; ").alias("text"))
    o = F.col("o_orderkey")
    both = F.array(*[F.struct(F.lit(t).alias("title"), F.lit(kind).alias("event_type"), (o % n == 0).alias("fixed")) for t, kind, n in [("Gym", "fitness", 3), ("Lunch", "social_meal", 2)]])
    plans = table(spark, d, "orders").select(o.alias("case_id"), F.explode(both).alias("e")).select("case_id", "e.*")
    return E.fixed_protection(said, plans).select("case_id", "passed", F.array_join("touched", ",").alias("touched"))


def q_lever_credit(spark: SparkSession, d: str) -> DataFrame:
    credit = E.lever_credit(_pick(_PATTERNS, F.col("l_orderkey") % 4), _pick(_SAID, F.col("l_partkey") % 6), _pick(_GROUND, F.col("l_suppkey") % 4), F.col("l_linestatus") == "O")
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_linestatus").alias("arm")).agg(F.max(credit).alias("credit"))


def q_decision_cases(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("pid"), F.col("o_orderdate").cast("date").alias("day"))
    cases = o.withColumn("pattern", _pick(_PATTERNS, F.col("case_id") % 4))
    states = o.groupBy("pid", "day").agg(F.max("case_id").alias("k")).select("pid", "day", F.array(_pick(_PATTERNS, F.col("pid") % 4)).alias("early"), F.array(_pick(_PATTERNS, F.col("k") % 3)).alias("later"))
    loads = o.groupBy("pid", "day").agg(F.count(F.lit(1)).alias("events"))
    results = _arms(spark, d).groupBy("case_id", "arm").agg(F.max("lever_pass").alias("lever_pass"), F.round(F.sum("burden"), 6).alias("burden"))
    out = E.decision_cases(cases, states, loads, results, "O")
    return out.select("case_id", "arm", "pid", "day", "pattern", F.array_join("names", ",").alias("names"), "events", "detected", "evidence", "lever_pass", "burden")


def q_raw_records(spark: SparkSession, d: str) -> DataFrame:
    """Raw rows of every person's days, as the digest of each stream's sorted records."""
    e = events(spark, d)
    days = e.select("pid", "day").distinct()
    spans = locked(spark, d).select(F.lit("lock").alias("stream"), "pid", "start", "end", F.concat_ws("/", F.unix_seconds(F.col("start").cast("timestamp")).cast("string"), F.unix_seconds(F.col("end").cast("timestamp")).cast("string")).alias("record"))
    points = e.select(F.col("kind").alias("stream"), "pid", "ts", F.col("event_id").cast("string").alias("record"))
    return I.raw_records(days, spans, points).select("pid", "day", "stream", "n", F.md5(F.array_join("records", ",").cast("binary")).alias("digest"))


QUERIES = {k[2:]: v for k, v in globals().items() if k.startswith("q_")}

_CAL = "cal as (select o_custkey as pid, o_orderkey % 5000 as id, s, s + to_minutes(30 * (1 + o_orderkey % 4)) as e, 'E' || o_orderkey as title, o_orderstatus = 'F' as fixed, o_orderkey % 10 = 0 as exam, o_orderkey % 7 = 0 as private, o_orderpriority as calendar, o_orderkey as okey from (select *, o_orderdate::timestamp + to_hours(o_orderkey % 24) as s from orders))"
_PROP = "prop as (select *, s + interval 30 minutes as e from (select o_custkey as pid, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as pkey, case when l_orderkey % 11 > 0 then o_orderdate::timestamp + to_hours(l_linenumber * 3 % 24) end as s, l_returnflag || l_linestatus as title, case when round(l_tax, 2) = 0 then 'delete' else 'add' end as action, l_orderkey * 10000000 + l_linenumber * 100000 + l_partkey % 100000 as place from lineitem join orders on l_orderkey = o_orderkey))"
_FREE = ", slots as (select okey as skey, pid, s::date as today, (okey % 24) * 60 as minute from cal), offs as (select *, today + o + to_minutes(minute) as ps from slots, (select unnest(range(1, 8))::int as o)), busy as (select distinct skey, o from offs f join cal c on c.pid = f.pid and f.ps < c.e - interval 1 minute and c.s < f.ps + interval 29 minutes), free as (select skey, min(o) as o from offs f where not exists (select 1 from busy b where b.skey = f.skey and b.o = f.o) group by skey), day as (select s.*, s.today + coalesce(f.o, 1) as free_day from slots s left join free f on f.skey = s.skey)"
_ARMS = "arms as (select *, lever_pass and burden_pass and specificity_pass as all_three from (select l_orderkey as case_id, l_linestatus as arm, l_linenumber as line, round(l_discount, 2) > 0.04 as lever_pass, round(l_tax, 2) > 0.03 as burden_pass, l_quantity > 20 as specificity_pass, l_quantity / 10 as burden, l_partkey % 4 as pattern, l_suppkey % 3 > 0 as detected from lineitem))"
_HM = hour_sql
_SUGG = f"sugg as (select l_orderkey as case_id, l_linenumber as line, {_WORDS!r}[1 + l_partkey % 6] as change, case when l_linenumber % 4 > 0 then (l_partkey % 20) * 60 end as a, (l_partkey % 20) * 60 + (l_suppkey % 13) * 15 as b from lineitem)"
_AVG = ", ".join(f"round(avg({c}::int), 6) as {c}" for c in PASSES)
_ANY = lambda x, ws: "(" + " or ".join(f"contains({x}, '{w}')" for w in ws) + ")"
_BY = lambda x, words: "case p " + " ".join(f"when '{p}' then {_ANY(x, ws)}" for p, ws in words.items()) + " end"
_TOUCH = rf"regexp_matches(text, '\b({E.CHANGES})\b.{{0,{E.NEAR}}}\b' || lower(title) || '\b|\b' || lower(title) || '\b.{{0,{E.NEAR}}}\b({E.CHANGES})\b')"
_LOCKED = "lockd as (select pid, s, e from (select pid, ts + to_seconds(floor(value)::int) as s, lead(ts) over (partition by pid order by ts, event_id) as e from ev) where e > s)"

SQL = {
    "merge_calendars": f'with {_CAL} select pid, id, s as start, e as "end", title from (select *, row_number() over (partition by pid, id order by s, calendar) as rn from cal where s < timestamp \'{HI}\' and e > timestamp \'{LO}\' and not private) where rn = 1',
    "schedule_summary": f"with {_CAL}, d as (select pid, s::date as day, count(*) as n, sum(date_sub('second', s, e) / 3600.0) as h from cal group by all) select pid, sum(n)::bigint as event_count, round(sum(h), 1)::double as total_hours, first(day order by n desc, day) as busiest_day, count(*) as days_covered from d group by pid",
    "schedule_tasks": f"with {_CAL} select pid, any_value(c) as task_count, string_agg(title || ' (' || coalesce(strftime(due, '%Y-%m-%d'), 'No due date') || ', ' || calendar || ')', '; ' order by n) as tasks from (select *, row_number() over (partition by pid order by due nulls last, okey) as n, count(*) over (partition by pid) as c from (select *, case when okey % 6 > 0 then s::date end as due from cal)) where n <= 10 group by pid",
    "busy_slots": f"with {_CAL} select pid, s::date as day, string_agg(strftime(s, '%H:%M') || '-' || strftime(e, '%H:%M') || ' ' || title, '; ' order by s, strftime(s, '%H:%M') || '-' || strftime(e, '%H:%M') || ' ' || title) as slots from cal group by all",
    "proposal_conflicts": f"with {_CAL}, {_PROP} select pkey, pid, s as start, title from prop p where action = 'add' and s is not null and not exists (select 1 from cal c where c.pid = p.pid and p.s < c.e - interval 1 minute and c.s < p.e - interval 1 minute)",
    "first_free_slot": f"with {_CAL}{_FREE} select skey, free_day from day",
    "promote_suggestions": f'with {_CAL}{_FREE}, p as (select skey, pid, free_day + to_minutes(minute) as s from day) select skey, pid, s as start, s + interval 30 minutes as "end" from p where not exists (select 1 from cal c where c.pid = p.pid and p.s < c.e - interval 1 minute and c.s < p.s + interval 29 minutes)',
    "dedupe_proposals": f"with {_PROP} select pid, 'walk ' || lower(left(title, 1)) || '|' || strftime(s, '%Y-%m-%dT%H:%M') as key, min(place) as place from prop where s is not null group by all",
    "proposal_outcomes": f"with {_PROP}, ok as (select distinct pid, lower(title) as t from prop where title in ('NO', 'AF')) select p.pid, case when o.t is null then 'rejected' else 'accepted' end as outcome, count(*) as n from prop p left join ok o on o.pid = p.pid and o.t = lower(p.title) group by all",
    "tz_mismatch": "select pid, string_agg(i::varchar, ',' order by i) as positions from (select l_orderkey as pid, case when l_orderkey % 3 = 0 then 'UTC' else 'Europe/Paris' end as own, case when l_linenumber % 2 = 0 then 'UTC' else 'Europe/Paris' end as zone, row_number() over (partition by l_orderkey order by l_linenumber, case when l_linenumber % 2 = 0 then 'UTC' else 'Europe/Paris' end) - 1 as i from lineitem) where own <> zone group by pid",
    "day_pressure": f"with {_CAL}, d as (select pid, s::date as day, coalesce(sum(date_sub('second', s, e) / 3600.0) filter (fixed), 0) as fixed_hours, coalesce(sum(date_sub('second', s, e) / 3600.0) filter (not fixed), 0) as flex_hours, coalesce(sum(date_sub('second', s, e) / 3600.0) filter (not fixed and hour(s) >= 20), 0) as late_flex_hours, count(*) filter (fixed) as fixed_count, count(*) as event_count, bool_or(exam) as exam_today from cal group by all) select pid, day, round(fixed_hours, 6)::double as fixed_hours, round(flex_hours, 6)::double as flex_hours, round(late_flex_hours, 6)::double as late_flex_hours, fixed_count, event_count, exam_today, bool_or(exam_today) over (partition by pid order by (day - date '1970-01-01') range between 2 preceding and 2 following) as exam_near from d",
    "calendar_window": f"with {_CAL}, d as (select distinct pid, s::date as day from cal) select d.pid, d.day, count(*) as n, string_agg(title, ', ' order by s, title) as titles from d join cal c on c.pid = d.pid and c.s::date between d.day and d.day + 6 group by all",
    "burden_score": f"""with {_SUGG}, b as (select case_id, round(sum(case when regexp_matches(lower(change), 'cancel|drop|skip|replace') then 1.3 else 0 end + case when regexp_matches(lower(change), 'move|reschedule|shift|delay|push') then 1.0 else 0 end
      + case when regexp_matches(lower(change), 'add|insert|schedule|protect') then 0.7 else 0 end + case when regexp_matches(lower(change), 'cap|shorten|trim') then 0.5 else 0 end
      + case when a is null then 0 when greatest(b % 1440 - a, 0) <= 20 then 0.2 when greatest(b % 1440 - a, 0) <= 45 then 0.45 when greatest(b % 1440 - a, 0) <= 90 then 0.8 else 1.2 end), 3)::double as burden from sugg group by case_id) select *, burden >= 2.5 as high_burden, burden <= 0.65 + 2.15 * ((case_id % 10) / 10) as ok from b""",
    "specificity": f"with {_SUGG} select case_id, bool_or(a is not null or contains(lower(change), 'lunch') or contains(lower(change), 'gym')) as specific from sugg group by case_id",
    "normalize_pattern": "select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as pattern from part",
    "evidence_type": f"with {_ARMS} select case when detected and pattern > 0 then 'pattern' when detected then 'partial_marker' else 'none' end as evidence, count(*) as n from arms group by 1",
    "arm_summary": f"with {_ARMS} select arm, count(*) as n, {_AVG} from arms group by arm",
    "detection_sensitivity": f"with {_ARMS} select coalesce(pattern::varchar, 'all') as pattern, count(*) as n, round(avg(detected::int), 6) as detected from arms group by rollup (pattern)",
    "conditional_quality": f"with {_ARMS} select arm, count(*) as n, {_AVG} from arms where case_id in (select case_id from arms where arm = 'O' and detected) group by arm",
    "restraint": f"with {_ARMS} select arm, count(*) as n, round(avg((burden >= 2.5)::int), 6) as high_burden, round(avg((burden < 0.5)::int), 6) as no_change from arms where case_id in (select case_id from arms where pattern = 0) group by arm",
    "credit_decomposition": f"with {_ARMS} select arm, count(*) as n, count(*) filter (detected) as n_with, round(avg(lever_pass::int) filter (detected), 6) as rate_with, round(avg(lever_pass::int) filter (not detected), 6) as rate_without, round(avg(lever_pass::int), 6) as rate, round(avg(lever_pass::int), 6) as reconstructed from arms group by arm",
    "miss_reasons": f"with {_ARMS} select coalesce(pattern::varchar, 'all') as pattern, coalesce(reason, 'all') as reason, count(*) as n from (select pattern, case when burden < 1 then 'no_data' when not lever_pass then 'below_threshold' else 'wrong_direction' end as reason from arms where not detected) group by cube (pattern, reason)",
    "blind_pairs": "with p as (select o_orderkey as case_id, o_orderstatus as aware, o_orderpriority as plain, ('0x' || left(md5('blind|' || o_orderkey), 2))::int % 2 = 1 as swap from orders) select case_id, 'A' as side, case when swap then 'plain' else 'aware' end as arm, case when swap then plain else aware end as text from p union all select case_id, 'B', case when swap then 'aware' else 'plain' end, case when swap then aware else plain end from p",
    "rater_summary": "with p as (select o_orderkey as case_id, ('0x' || left(md5('blind|' || o_orderkey), 2))::int % 2 = 1 as swap from orders), r as (select case_id, 'A' as side, case when swap then 'plain' else 'aware' end as arm, case_id * 3 % 5 as rating from p union all select case_id, 'B', case when swap then 'aware' else 'plain' end, case_id * 5 % 5 from p) select arm, count(*) as n, round(avg(rating), 6) as mean_rating, round(avg((rn = 1)::int), 6) as preference_rate from (select *, row_number() over (partition by case_id order by rating desc, side) as rn from r) group by arm",
    "suggestion_text": f"with {_SUGG} select case_id, md5(string_agg(n || '. ' || change, chr(10) order by n)) as digest from (select *, row_number() over (partition by case_id order by line, change) as n from sugg) group by case_id",
    "recovery": f"with {_ARMS} select coalesce(pattern::varchar, 'all') as pattern, count(*) as n, round(avg(detected::int), 6) as detected, (select round(avg(o::int), 6) from (select case_id % 500 as p, bool_or(detected) as o from arms group by 1)) as people_once from arms group by rollup (pattern)",
    "fixed_protection": f"""with said as (select l_orderkey as case_id, lower(string_agg(t, '; ' order by t)) as text from (select l_orderkey, {_SAID!r}[1 + l_partkey % 6] as t from lineitem) group by 1), plans as (select o_orderkey as case_id, 'Gym' as title, 'fitness' as kind, o_orderkey % 3 = 0 as fixed from orders union all select o_orderkey, 'Lunch', 'social meal', o_orderkey % 2 = 0 from orders),
      j as (select case_id, text, title, coalesce(fixed and contains(text, lower(title)) and {_TOUCH}, false) as changed, coalesce(not fixed and (contains(text, lower(title)) or contains(text, kind)), false) or {_ANY("text", E.SUPPORT)} as aimed from said left join plans using (case_id))
      select case_id, not bool_or(changed) and bool_or(aimed) and bool_or(trim(text) <> '') as passed, coalesce(string_agg(distinct title, ',' order by title) filter (changed), '') as touched from j group by case_id""",
    "lever_credit": f"""with r as (select l_orderkey as case_id, l_linestatus as arm, {_PATTERNS!r}[1 + l_orderkey % 4] as p, lower({_SAID!r}[1 + l_partkey % 6]) as t, {_GROUND!r}[1 + l_suppkey % 4] as g from lineitem)
      select case_id, arm, bool_or({_BY("t", E.MECHANISM)} or (arm = 'O' and (contains(g, p) or {_BY("g", E.GROUNDS)} or {_BY("t", E.ACTIONS)}))) as credit from r group by all""",
    "decision_cases": f"""with {_ARMS}, o as (select o_orderkey as case_id, o_custkey as pid, o_orderdate::date as day from orders), st as (select pid, day, list_sort(list_distinct([{_PATTERNS!r}[1 + pid % 4], {_PATTERNS!r}[1 + max(case_id) % 3]])) as names, count(*) as events from o group by pid, day),
      r as (select case_id, arm, bool_or(lever_pass) as lever_pass, round(sum(burden), 6)::double as burden from arms group by all), c as (select *, {_PATTERNS!r}[1 + case_id % 4] as pattern from o)
      select case_id, arm, pid, day, pattern, array_to_string(names, ',') as names, events, list_contains(names, pattern) as detected, list_contains(names, pattern) and arm = 'O' as evidence, lever_pass, burden from c join st using (pid, day) join r using (case_id)""",
    "raw_records": with_(["ev"], """select pid, day, stream, count(*) as n, md5(string_agg(record, ',' order by record)) as digest from (
      select d.pid, d.day, 'lock' as stream, floor(epoch(s))::bigint || '/' || floor(epoch(e))::bigint as record from days d join lockd l on l.pid = d.pid and e > d.day::timestamp - interval 4 hours and s < d.day::timestamp + interval 28 hours
      union all select d.pid, d.day, kind, event_id::varchar from days d join ev on ev.pid = d.pid and ts >= d.day::timestamp + interval 4 hours and ts < d.day::timestamp + interval 28 hours) group by all""", {"days": "select distinct pid, day from ev", "lockd": _LOCKED.split(" as ", 1)[1][1:-1]}),
}
