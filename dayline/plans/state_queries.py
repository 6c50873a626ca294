"""Queries of state documents and of the participant warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayline.functions import registry
from dayline.operators import baseline as B
from dayline.operators import memory as M
from dayline.operators import state as S
from dayline.plans.fixtures import framed, hour_sql, marker_long, quality_sql, table, with_

R, N, WARM = 4, 21, 10
_md5 = lambda c: F.md5(F.col(c).cast("binary"))


def _devs(spark, d):
    return B.deviations(marker_long(spark, d), R, N)


def q_overall_confidence(spark: SparkSession, d: str) -> DataFrame:
    return S.overall_confidence(marker_long(spark, d), _devs(spark, d), WARM)


def q_coverage_notes(spark: SparkSession, d: str) -> DataFrame:
    return S.coverage_notes(marker_long(spark, d)).select("pid", "day", F.array_join("notes", "; ").alias("notes"))


def q_deviation_findings(spark: SparkSession, d: str) -> DataFrame:
    return S.findings(_devs(spark, d)).select("pid", "day", "marker", "finding")


def q_risk_level(spark: SparkSession, d: str) -> DataFrame:
    long, devs = marker_long(spark, d), _devs(spark, d)
    return S.risk_level(devs, B.coherent_patterns(devs), B.warmth(long.select("pid", "day").distinct(), WARM))


def q_risk_from_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", S.risk_from_text(F.col("text")).alias("risk"))


def _state(spark, d):
    return S.state_documents(marker_long(spark, d), R, N, WARM)


def q_state_document(spark: SparkSession, d: str) -> DataFrame:
    s = _state(spark, d)
    return s.select("pid", "day", "warm", "confidence", F.greatest(F.size(F.coalesce("deviations", F.array().cast(s.schema["deviations"].dataType))), F.lit(0)).alias("n_dev"), F.size("notes").alias("n_notes"))


def q_state_prose(spark: SparkSession, d: str) -> DataFrame:
    return S.prose(_state(spark, d)).select("pid", "day", "prose")


def q_latest_warm_state(spark: SparkSession, d: str) -> DataFrame:
    return S.latest_warm(_state(spark, d).select("pid", "day", "warm", "confidence")).select("pid", "day", "confidence")


def q_sample_prose(spark: SparkSession, d: str) -> DataFrame:
    return S.prose(S.sample_prose(_state(spark, d))).select("pid", "day", "prose")


def q_payload_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of each day's state, markers and raw events as JSON: means, medians, and the state's share of the others."""
    state = S.prose(_state(spark, d))
    some = lambda c: F.coalesce(c, F.array().cast(state.schema[c].dataType)).alias(c)
    s = state.select("pid", "day", F.octet_length(F.to_json(F.struct("confidence", some("deviations"), some("patterns"), "notes", "prose"))).alias("state"))
    parts = lambda *cs: (F.sum(F.octet_length(F.to_json(F.struct(*cs))) + 1) + 1)
    text = lambda c, n: F.coalesce(S.fixed(F.col(c), n), F.lit("")).alias(c)
    m = marker_long(spark, d).groupBy("pid", "day").agg(parts("marker", text("value", 6), text("coverage", 3)).alias("markers"))
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")).groupBy(F.col("user_id").alias("pid"), F.to_date("ts").alias("day"))
    e = e.agg(parts(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.coalesce("event_type", F.lit("")).alias("kind"), text("value", 2), F.coalesce("props", F.lit("")).alias("props")).alias("raw"))
    j = s.join(m, ["pid", "day"]).join(e, ["pid", "day"])
    sizes = [f(c).alias(f"{c}_{n}") for c in ("state", "markers", "raw") for n, f in (("mean", F.avg), ("median", F.median))]
    t = j.agg(F.count(F.lit(1)).alias("days"), *sizes, F.median(F.col("markers") / F.col("state")).alias("markers_ratio"), F.median(F.col("raw") / F.col("state")).alias("raw_ratio"))
    return t.select("*", (F.col("state_mean") / F.col("markers_mean")).alias("state_to_markers"), (F.col("state_mean") / F.col("raw_mean")).alias("state_to_raw"))


def q_payload_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Days on which a pattern fired, by confidence."""
    s = _state(spark, d).where(F.col("warm") & (F.size("patterns") > 0))
    return s.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))


def q_candidate_days(spark: SparkSession, d: str) -> DataFrame:
    return S.candidate_days(_state(spark, d))


def q_state_field_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths at any depth of the scheduler's payloads."""
    return S.field_paths(q_scheduler_payload(spark, d), "payload")


def q_risk_searches(spark: SparkSession, d: str) -> DataFrame:
    return S.risk_searches(S.prose(S.risk_of_state(_state(spark, d)).where("warm")))


def q_field_paths(spark: SparkSession, d: str) -> DataFrame:
    """Distinct keys of the events' JSON with their number of rows."""
    e = table(spark, d, "events").select(F.explode(F.json_object_keys("props")).alias("path"))
    return e.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def _journals(spark, d):
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("user"), F.when(F.col("turn") % 5 > 0, F.col("turn") % 3).alias("journal_id"), F.col("turn").alias("place"), F.col("role").alias("period"), "text")


def q_anon_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", M.anon_id(F.col("c_custkey")).alias("anon"))


def q_sanitize_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", M.sanitize_id(F.col("url")).alias("id"))


def q_dedupe_journals(spark: SparkSession, d: str) -> DataFrame:
    j = _journals(spark, d)
    stored = j.where("user % 4 = 0 and journal_id = 1").select("user", "journal_id").distinct()
    return M.dedupe_journals(j, stored).select("user", "journal_id", "place")


def q_enrollments(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("user"), F.col("o_orderpriority").alias("study"), "o_orderdate", "o_orderkey")
    return M.first_rows(o, ["user", "study"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("user", "study", "o_orderkey")


def q_accept_latest(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("user"), "o_orderdate", "o_orderkey")
    new = M.first_rows(o, ["user"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_orderkey", F.lit(True).alias("ok"))
    return o.join(new, "o_orderkey", "left").select("o_orderkey", F.coalesce("ok", F.lit(False)).alias("accepted"))


def _sessions(spark, d):
    """One document for each conversation: even turns are recommendations, odd ones journals, every third a proposed change."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    of = lambda test, make: F.transform(F.filter("t", test), make)
    when = lambda x, name, even: F.when(x["turn"] % 4 == even, x["role"]).alias(name)
    doc = F.struct(
        F.get("t.text", F.lit(0)).alias("journal_summary"),
        F.when(F.col("conv_id") % 4 > 0, F.struct(F.when(F.col("conv_id") % 2 == 0, "moderate").otherwise("mild").alias("risk_level"), F.slice("t.role", 1, 2).alias("key_concerns"))).alias("wellbeing"),
        of(lambda x: x["turn"] % 2 == 0, lambda x: F.struct(x["text"].alias("action"), when(x, "when", 0), when(x, "when_to_do", 2))).alias("recommendations"),
        of(lambda x: x["turn"] % 2 == 1, lambda x: F.struct(F.when(x["turn"] % 5 > 0, F.concat(F.lit("j"), (x["turn"] % 3).cast("string"))).alias("id"), x["turn"].alias("entry_number"), x["role"].alias("period"), x["text"].alias("content"))).alias("journals"),
        of(lambda x: x["turn"] % 3 == 2, lambda x: F.struct(x["role"].alias("title"), x["turn"].alias("place"))).alias("proposed_changes"),
    )
    return c.select(F.col("conv_id").alias("session"), (F.col("conv_id") % 500).alias("user"), F.to_json(doc).alias("doc"))


def q_session_children(spark: SparkSession, d: str) -> DataFrame:
    """Recommendations of session documents, one row each, with their whole texts; the older name of the time field is read too."""
    r = M.explode_session(_sessions(spark, d))["recommendations"]
    return r.select("session", F.col("n").cast("long").alias("n"), F.length("action").alias("chars"), F.md5(F.col("action").cast("binary")).alias("action"), F.col("when_to_do").alias("timing"))


def q_session_tables(spark: SparkSession, d: str) -> DataFrame:
    """The rows of all child tables of a session, each with its main content."""
    t = M.explode_session(_sessions(spark, d))
    row = lambda name, session, n, content: t[name].select(F.lit(name).alias("child"), session.cast("long").alias("session"), n.cast("long").alias("n"), content.alias("content"))
    s, zero, md5 = F.col("session"), F.lit(0), lambda *cs: F.md5(F.concat_ws("|", *cs).cast("binary"))
    parts = [
        row("users", F.lit(None), zero, F.col("user")),
        row("journal_sessions", s, zero, md5("user", "journal_count", "journal_summary")),
        row("wellbeing_assessments", s, zero, F.concat_ws("|", "risk_level", "key_concerns", "positive_indicators")),
        row("recommendations", s, F.col("n"), md5("action", "when_to_do")),
        row("raw_journals", s, F.col("entry_number"), md5("user", "journal_id", "period", "content")),
        row("calendar_proposals", s, zero, F.concat_ws("|", "proposed_changes", "accepted")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _assessments(spark, d):
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    level = F.when(digit.between(1, 4), F.element_at(F.array(*[F.lit(x) for x in reversed(M.RISKS)]), F.least(digit, F.lit(4))))
    place = F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).cast("long") * 10000000 + F.col("o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("user"), level.alias("level"), place.cast("long").alias("place"))


def q_risk_trend(spark: SparkSession, d: str) -> DataFrame:
    return M.risk_trend(_assessments(spark, d))


def q_latest_risk(spark: SparkSession, d: str) -> DataFrame:
    a = _assessments(spark, d)
    return M.first_rows(a, ["user"], [F.col("place").desc()]).select("user", F.coalesce("level", F.lit("unknown")).alias("level"))


def q_risk_history(spark: SparkSession, d: str) -> DataFrame:
    return M.risk_history(_assessments(spark, d))


def _feedback(spark, d):
    l = table(spark, d, "lineitem")
    action = F.when(F.col("l_returnflag") == "A", "accept").when(F.col("l_returnflag") == "R", "reject").otherwise("noshow")
    place = F.col("l_orderkey") * 10000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey") % 100000
    return l.select((F.col("l_orderkey") % 1000).alias("user"), action.alias("action"), F.concat(F.lit("s"), (F.col("l_partkey") % 50).cast("string")).alias("suggestion"), place.alias("place"))


def q_feedback_history(spark: SparkSession, d: str) -> DataFrame:
    last = M.first_rows(_feedback(spark, d), ["user"], [F.col("place").desc(), F.col("suggestion").desc(), F.col("action").desc()], 5)
    return last.groupBy("user").agg(F.array_join(F.sort_array(F.collect_list(F.struct("place", "suggestion", "action")))["suggestion"], ",").alias("last"))


def _preferences(spark, d):
    f = _feedback(spark, d).select("user", F.when(F.col("action") == "accept", "prefer").when(F.col("action") == "reject", "avoid").otherwise("explicit").alias("kind"), F.when(F.col("place") % 2 == 0, F.upper("suggestion")).otherwise(F.concat(F.lit(" "), "suggestion")).alias("value"), "place")
    return M.prompt_lines(f.groupBy("user", "kind", "value").agg(F.min("place").alias("place")))


def q_prompt_prefs(spark: SparkSession, d: str) -> DataFrame:
    return _preferences(spark, d)


def q_suggestion_feedback(spark: SparkSession, d: str) -> DataFrame:
    f = _feedback(spark, d).where("action in ('accept', 'reject')").groupBy("user", "action").agg(F.sort_array(F.collect_set("suggestion")).alias("s"))
    return f.groupBy("user").agg(F.array_join(F.max(F.when(F.col("action") == "accept", F.col("s"))), ",").alias("accepted"), F.array_join(F.max(F.when(F.col("action") == "reject", F.col("s"))), ",").alias("rejected"))


def q_user_context(spark: SparkSession, d: str) -> DataFrame:
    f = _feedback(spark, d).groupBy("user").agg(F.count(F.lit(1)).alias("feedback"))
    return M.user_context(_preferences(spark, d), _assessments(spark, d), f)


def q_journals_by_day(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("user"), F.to_date("o_orderdate").alias("day"))
    per = o.groupBy("user", "day").agg(F.count(F.lit(1)).alias("n"))
    return M.first_rows(per, ["user"], [F.col("day").desc()], 10)


def q_blank_journals(spark: SparkSession, d: str) -> DataFrame:
    j = _journals(spark, d).withColumn("content", F.when(F.col("place") % 3 == 0, F.lit("  ")).otherwise(F.col("text")))
    return j.where("content is null or trim(content) = ''").groupBy("user").agg(F.array_join(F.sort_array(F.collect_list("place")).cast("array<string>"), ",").alias("blank"))


def q_expand_queries(spark: SparkSession, d: str) -> DataFrame:
    """Search texts of each day: up to four deviations and up to three patterns."""
    from dayline.functions.columns import shortened

    s = _state(spark, d).where("warm")
    dev = F.transform(F.slice("deviations", 1, 4), lambda x: F.concat(F.replace(x["marker"], F.lit("_"), F.lit(" ")), F.lit(" "), x["direction"]))
    pat = F.transform(F.slice("patterns", 1, 3), lambda x: F.replace(x["pattern"], F.lit("-"), F.lit(" ")))
    none = F.array().cast("array<string>")
    q = s.select("pid", "day", F.posexplode(F.concat(F.coalesce(dev, none), F.coalesce(pat, none))).alias("n", "query"))
    return q.select("pid", "day", "n", shortened(F.col("query"), 80).alias("query"))


def _week(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    start = F.timestamp_add("HOUR", (k % 24).cast("int"), F.timestamp_add("DAY", (k % 37).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")))
    return o.select(F.col("o_custkey").alias("pid"), start.alias("start"), F.timestamp_add("MINUTE", (30 * (1 + k % 4)).cast("int"), start).alias("end"), F.concat(F.lit("E"), k.cast("string")).alias("title"))


def q_scheduler_payload(spark: SparkSession, d: str) -> DataFrame:
    last = M.first_rows(_feedback(spark, d), ["user"], [F.col("place").desc(), F.col("suggestion").desc(), F.col("action").desc()], 5)
    return S.scheduler_payload(S.prose(_state(spark, d)), _week(spark, d), _preferences(spark, d).withColumnRenamed("user", "pid"), last.withColumnRenamed("user", "pid"))


QUERIES = {k[2:]: v for k, v in globals().items() if k.startswith("q_")}

_Q7 = f"select *, {quality_sql('a')} as quality from (select *, avg(coverage) over {framed(-6, 0)} as a from long)"
_C = lambda c: f"case {c} when 'high' then 2 when 'medium' then 1 when 'low' then 0 else -1 end"
_CONF = f"""select h.pid, h.day, h.history >= 10 as warm, h.history, case when h.history < 10 then 'low-cold-start' when coalesce(d.s, m.s) >= 2 * coalesce(d.n, m.n) then 'high' when coalesce(d.s, m.s) >= coalesce(d.n, m.n) then 'medium' else 'low' end as confidence
from history h left join (select pid, day, sum({_C('coverage')}) as s, count(*) as n from devs group by all) d on d.pid = h.pid and d.day = h.day join (select pid, day, sum({_C('quality')}) as s, count(*) as n from q7 group by all) m on m.pid = h.pid and m.day = h.day"""
_RISK = """select pid, day, case when history < 10 then 'minimal' when s >= 6 or m >= 3 then 'severe' when s >= 3.5 or m >= 2 or p >= 2 then 'moderate' when s >= 1 then 'mild' else 'minimal' end as risk
from (select h.pid, h.day, h.history, round(coalesce(s, 0) + least(coalesce(p, 0), 3) * 1.25, 9) as s, coalesce(m, 0) as m, coalesce(p, 0) as p from history h
left join (select pid, day, sum(w * c) as s, count(*) filter (w >= 2 and c >= 0.75) as m from (select *, case magnitude when 'mild' then 1 when 'moderate' then 2 when 'pronounced' then 3 else 0 end as w, case coverage when 'high' then 1.0 when 'medium' then 0.75 when 'low' then 0.4 else 0.0 end as c from devs) group by all) d on d.pid = h.pid and d.day = h.day
left join (select pid, day, count(*) as p from pats group by all) p on p.pid = h.pid and p.day = h.day)"""
_SAY = "select * from (values " + ", ".join("('" + m + "', '" + subject.replace("'", "''") + f"', '{more}', '{less}', '{unit}', {'null' if places is None else places}, {factor})" for m, subject, more, less, unit, places, factor in registry.SAYINGS) + ") t(marker, subject, more, less, unit, places, factor)"
_FIX = lambda x, n: f"printf('%.{n}f', floor({x} * {10**n} + 0.5 + 1e-9) / {10**n})"
_SHOWN = lambda c: f"case when places is null then {hour_sql(f'round({c}, 6)')} else case places when 0 then {_FIX(f'(round({c}, 6) * factor)', 0)} when 1 then {_FIX(f'(round({c}, 6) * factor)', 1)} else {_FIX(f'(round({c}, 6) * factor)', 2)} end || unit end"
_LAST = "regexp_extract(trajectory, '(\\d+)d$', 1)"
_FOUND = f"""select d.*, subject || ' is ' || case when recent_mean > baseline_mean then more else less end || ': ' || {_SHOWN('recent_mean')} || ' against a usual ' || {_SHOWN('baseline_mean')}
  || case when starts_with(trajectory, 'sustained') then ', on each of the last ' || {_LAST} || ' days' when starts_with(trajectory, 'drift') then ', growing over the last ' || {_LAST} || ' days'
     when starts_with(trajectory, 'intermittent') then ', on ' || regexp_extract(trajectory, '(\\d+)d-of-(\\d+)', 1) || ' of the last ' || regexp_extract(trajectory, '(\\d+)d-of-(\\d+)', 2) || ' days' when starts_with(trajectory, 'acute') then ', on one day' else '' end as finding
from devs d join say on say.marker = d.marker"""
_HEADS = {"sleep": "Sleep:", "screen": "Screen & attention:", "mobility": "Mobility & location routine:", "social": "Social rhythm & communication:"}
_PARTS = ", ".join(f"'{v}' || chr(10) || string_agg('  * ' || finding || ' [' || magnitude || ', coverage: ' || coverage || ']', chr(10) order by position) filter (domain = '{k}') as s_{k}" for k, v in _HEADS.items())
_DOC = f"""select c.pid, c.day, warm, history, confidence, coalesce(case when warm then deviations end, []) as deviations, coalesce(case when warm then patterns end, []) as patterns, coalesce(notes, []) as notes,
  case when not warm then 'As of ' || c.day || ': ' || history || ' days of history, still learning the baseline.' when deviations is null then 'As of ' || c.day || ': within the typical range; nothing stands out.'
    else concat_ws(chr(10) || chr(10), 'As of ' || c.day || ' (overall confidence: ' || confidence || '):', s_sleep, s_screen, s_mobility, s_social, 'Patterns:' || chr(10) || pt, 'Caveats:' || chr(10) || nt) end as prose
from ({_CONF}) c
left join (select pid, day, list({{'position': position, 'domain': domain, 'marker': marker, 'finding': finding, 'magnitude': magnitude, 'trajectory': trajectory, 'direction': direction, 'coverage': coverage}} order by position) as deviations, {_PARTS} from found group by all) f on f.pid = c.pid and f.day = c.day
left join (select pid, day, list({{'pattern_position': pattern_position, 'pattern': pattern, 'implicated': implicated}} order by pattern_position) as patterns, string_agg('  * ' || pattern || ' (signals: ' || array_to_string(implicated, ', ') || ')', chr(10) order by pattern_position) as pt from pats group by all) p on p.pid = c.pid and p.day = c.day
left join (select pid, day, list(note order by position) as notes, string_agg('  * ' || note, chr(10) order by position) as nt from (select q.pid, q.day, s.position, s.domain || '/' || q.marker || ': coverage ' || quality as note from q7 q join spec s on s.marker = q.marker where quality in ('low', 'none')) group by all) n on n.pid = c.pid and n.day = c.day"""
_STATE = {"q7": _Q7, "say": _SAY, "found": _FOUND, "doc": _DOC}


def _doc_sql(query: str, extra: dict[str, str] | None = None) -> str:
    return with_(["history", "devs", "long", "pats", "spec"], query, {**_STATE, **(extra or {})})


_FEED = "feed as (select l_orderkey % 1000 as user_, case l_returnflag when 'A' then 'accept' when 'R' then 'reject' else 'noshow' end as action, 's' || (l_partkey % 50) as suggestion, l_orderkey * 10000000 + l_linenumber * 100000 + l_partkey % 100000 as place from lineitem)"
_ASS = "ass as (select o_custkey as user_, case left(o_orderpriority, 1) when '1' then 4 when '2' then 3 when '3' then 2 when '4' then 1 end as r, date_sub('day', date '1990-01-01', o_orderdate::date) * 10000000 + o_orderkey as place from orders)"
_TREND = ", trend as (select u.user_, case when c is null or c <= 3 then 'insufficient_data' when a - b > 0.5 then 'rising' when a - b < -0.5 then 'falling' else 'stable' end as trend from (select distinct user_ from ass) u left join (select user_, count(*) as c, avg(r) filter (n <= 3) as a, avg(r) filter (n > 3) as b from (select *, row_number() over (partition by user_ order by place desc) as n from ass where r is not null) where n <= 6 group by user_) s on s.user_ = u.user_), latest as (select user_, coalesce(['minimal', 'mild', 'moderate', 'severe'][r], 'unknown') as level from (select *, row_number() over (partition by user_ order by place desc) as n from ass) where n = 1)"
_LINES = """select user_, kind, case kind when 'avoid' then 'Avoid: ' when 'prefer' then 'Prefer: ' else '' end || string_agg(value, ', ' order by place, value) as line from (select *, row_number() over (partition by user_, kind, lower(value) order by place) as n from (
  select user_, case action when 'accept' then 'prefer' when 'reject' then 'avoid' else 'explicit' end as kind, trim(case when place % 2 = 0 then upper(suggestion) else ' ' || suggestion end) as value, min(place) as place from feed group by all)) where n = 1 group by user_, kind"""
_PAYLOAD = """select l.pid, l.day, to_json({'behavioral_state': {'confidence': confidence, 'deviations': deviations, 'patterns': patterns, 'notes': notes}, 'behavioral_state_prose': prose, 'calendar': coalesce(cal, []), 'preferences': coalesce(prefs, []), 'feedback': coalesce(told, [])})::varchar as payload
from (select * from doc where warm qualify row_number() over (partition by pid order by day desc) = 1) l
left join (select d.pid, list({'start': strftime(s, '%Y-%m-%dT%H:%M'), 'end': strftime(s + to_minutes(30 * (1 + k % 4)), '%Y-%m-%dT%H:%M'), 'title': 'E' || k} order by s, s + to_minutes(30 * (1 + k % 4)), 'E' || k) as cal
  from (select pid, max(day) as day from doc where warm group by pid) d join (select o_custkey as pid, o_orderkey as k, timestamp '2024-01-01' + to_days((o_orderkey % 37)::int) + to_hours(o_orderkey % 24) as s from orders) o on o.pid = d.pid and s >= d.day and s < d.day + 7 group by d.pid) c on c.pid = l.pid
left join (select user_, list(line order by kind, line) as prefs from lines group by user_) w on w.user_ = l.pid
left join (select user_, list({'suggestion': suggestion, 'action': action} order by place, suggestion, action) as told from (select *, row_number() over (partition by user_ order by place desc, suggestion desc, action desc) as n from feed) where n <= 5 group by user_) t on t.user_ = l.pid"""
_FEEDS = {"feed": _FEED[len("feed as ("):-1], "lines": _LINES}
SQL = {
    "overall_confidence": with_(["history", "devs", "long"], f"select pid, day, confidence from ({_CONF})", {"q7": _Q7}),
    "coverage_notes": with_(["long", "spec"], "select pid, day, string_agg(s.domain || '/' || q.marker || ': coverage ' || quality, '; ' order by s.position) as notes from q7 q join spec s on s.marker = q.marker where quality in ('low', 'none') group by pid, day", {"q7": _Q7}),
    "risk_level": with_(["history", "devs", "pats"], _RISK),
    "risk_from_text": f"select conv_id, turn, case when regexp_matches(lower(text), '{S.SEVERE_WORDS}') then 'moderate' when regexp_matches(lower(text), '{S.MILD_WORDS}') then 'mild' else 'minimal' end as risk from conversations",
    "state_document": with_(["history", "devs", "long"], f"select c.pid, c.day, warm, confidence, case when warm then coalesce(n_dev, 0) else 0 end::int as n_dev, coalesce(n_notes, 0)::int as n_notes from ({_CONF}) c left join (select pid, day, count(*) as n_dev from devs group by all) d on d.pid = c.pid and d.day = c.day left join (select pid, day, count(*) as n_notes from q7 where quality in ('low', 'none') group by all) n on n.pid = c.pid and n.day = c.day", {"q7": _Q7}),
    "latest_warm_state": with_(["history", "devs", "long"], f"select pid, max(day) as day, arg_max(confidence, day) as confidence from ({_CONF}) where warm group by pid", {"q7": _Q7}),
    "payload_candidates": with_(["history", "devs", "long", "pats"], f"select confidence, count(*) as n from ({_CONF}) c where warm and exists (select 1 from pats p where p.pid = c.pid and p.day = c.day) group by 1", {"q7": _Q7}),
    "field_paths": "select path, count(*) as n from (select unnest(json_keys(props)) as path from events) group by path",
    "anon_id": "select c_custkey, sha256(c_custkey::varchar) as anon from customer",
    "sanitize_id": "select page_id, regexp_replace(left(url, 64), '[^A-Za-z0-9_-]', '_', 'g') as id from pages",
    "dedupe_journals": 'with j as (select conv_id as u, case when turn % 5 > 0 then turn % 3 end as journal_id, turn as place from conversations) select u as "user", journal_id, min(place) as place from j where journal_id is not null and not (u % 4 = 0 and journal_id = 1) group by all union all select u, journal_id, place from j where journal_id is null',
    "enrollments": 'select o_custkey as "user", o_orderpriority as study, first(o_orderkey order by o_orderdate, o_orderkey) as o_orderkey from orders group by 1, 2',
    "accept_latest": "select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1 as accepted from orders",
    "session_children": "select conv_id as session, row_number() over (partition by conv_id order by turn, role, text) - 1 as n, length(text) as chars, md5(text) as action, role as timing from conversations where turn % 2 = 0",
    "risk_trend": f'with {_ASS}{_TREND} select user_ as "user", trend from trend',
    "latest_risk": f'with {_ASS}{_TREND} select user_ as "user", level from latest',
    "feedback_history": f"""with {_FEED} select user_ as "user", string_agg(suggestion, ',' order by place, suggestion, action) as last from (select *, row_number() over (partition by user_ order by place desc, suggestion desc, action desc) as n from feed) where n <= 5 group by 1""",
    "prompt_prefs": f"""with {_FEED}, v as (select user_, case action when 'accept' then 'prefer' when 'reject' then 'avoid' else 'explicit' end as kind, trim(case when place % 2 = 0 then upper(suggestion) else ' ' || suggestion end) as value, min(place) as place from feed group by all), f as (select *, row_number() over (partition by user_, kind, lower(value) order by place) as n from v)
select user_ as "user", kind, case kind when 'avoid' then 'Avoid: ' when 'prefer' then 'Prefer: ' else '' end || string_agg(value, ', ' order by place, value) as line from f where n = 1 group by user_, kind""",
    "suggestion_feedback": f"""with {_FEED} select user_ as "user", array_to_string(list_sort(list_distinct(list(suggestion) filter (action = 'accept'))), ',') as accepted, array_to_string(list_sort(list_distinct(list(suggestion) filter (action = 'reject'))), ',') as rejected from feed where action in ('accept', 'reject') group by 1""",
    "user_context": f"""with {_ASS}{_TREND}, {_FEED}, lines as ({_LINES}), w as (select user_, string_agg(line, '; ' order by kind, line) as preferences from lines group by 1), f as (select user_, count(*) as feedback from feed group by 1)
select user_ as "user", coalesce(preferences, '') as preferences, coalesce(trend, 'insufficient_data') as trend, coalesce(level, 'unknown') as level, coalesce(feedback, 0) as feedback from trend full join latest using (user_) full join f using (user_) full join w using (user_)""",
    "risk_history": f"""with {_ASS} select user_ as "user", string_agg(['minimal', 'mild', 'moderate', 'severe'][r], ',' order by place) as history from (select *, row_number() over (partition by user_ order by place desc) as n from ass where r is not null) where n <= 7 group by user_""",
    "journals_by_day": 'select u as "user", day, n from (select *, row_number() over (partition by u order by day desc) as rn from (select o_custkey as u, o_orderdate::date as day, count(*) as n from orders group by all)) where rn <= 10',
    "blank_journals": """select conv_id as "user", string_agg(turn::varchar, ',' order by turn) as blank from conversations where turn % 3 = 0 or text is null or trim(text) = '' group by 1""",
}

SQL["expand_queries"] = with_(["devs", "pats", "history"], """
select pid, day, (row_number() over (partition by pid, day order by kind, place) - 1)::int as n, query from (
  select d.pid, d.day, 0 as kind, row_number() over (partition by d.pid, d.day order by position) as place, replace(marker, '_', ' ') || ' ' || direction as query from devs d
  union all select pid, day, 1, row_number() over (partition by pid, day order by pattern_position), replace(pattern, '-', ' ') from pats) q
where place <= case kind when 0 then 4 else 3 end and exists (select 1 from history h where h.pid = q.pid and h.day = q.day and h.history >= 10)""")

_SIZE = {
    "sizes": """select s.pid, s.day, strlen(to_json({'confidence': confidence, 'deviations': deviations, 'patterns': patterns, 'notes': notes, 'prose': prose})::varchar) as state, markers, raw from doc s
join (select pid, day, sum(strlen(to_json({'marker': marker, 'value': coalesce(""" + _FIX("value", 6) + """, ''), 'coverage': coalesce(""" + _FIX("coverage", 3) + """, '')})::varchar) + 1) + 1 as markers from long group by all) m on m.pid = s.pid and m.day = s.day
join (select user_id as pid, ts::date as day, sum(strlen(to_json({'ts': strftime(ts, '%Y-%m-%d %H:%M:%S'), 'kind': event_type, 'value': coalesce(""" + _FIX("value", 2) + """, ''), 'props': props})::varchar) + 1) + 1 as raw from events group by all) e on e.pid = s.pid and e.day = s.day"""
}
SQL |= {
    "deviation_findings": with_(["devs"], "select pid, day, marker, finding from found", {"say": _SAY, "found": _FOUND}),
    "state_prose": _doc_sql("select pid, day, prose from doc"),
    "sample_prose": _doc_sql("select pid, day, prose from (select *, row_number() over (partition by pid order by day) as n from doc where warm and len(patterns) > 0) where n <= 2 order by pid, day limit 20"),
    "candidate_days": _doc_sql("select pid, day, confidence, len(deviations)::int as n_dev, len(patterns)::int as n_pat, array_to_string(list_transform(patterns, lambda x: x.pattern), '|') as pattern_names from doc where warm and len(patterns) > 0 and confidence in ('high', 'medium')"),
    "payload_sizes": _doc_sql("select count(*) as days, " + ", ".join(f"{f}({c}) as {c}_{n}" for c in ("state", "markers", "raw") for n, f in (("mean", "avg"), ("median", "median"))) + ", median(markers / state) as markers_ratio, median(raw / state) as raw_ratio, avg(state) / avg(markers) as state_to_markers, avg(state) / avg(raw) as state_to_raw from sizes", _SIZE),
    "scheduler_payload": _doc_sql(_PAYLOAD, _FEEDS),
    "state_field_paths": _doc_sql(r"select path, count(*) as n from (select regexp_replace(regexp_replace(fullkey[3:], '\[\d+\]', '[]', 'g'), '\"', '', 'g') as path from payloads, json_tree(payloads.payload::json)) where path <> '' group by path", {**_FEEDS, "payloads": _PAYLOAD}),
    "risk_searches": _doc_sql("""select d.pid, d.day, n::int as n, trim(concat_ws(' ', case risk when 'severe' then """ + str(registry.RISK_SEARCHES["severe"]) + """ when 'moderate' then """ + str(registry.RISK_SEARCHES["moderate"]) + """ else """ + str(registry.RISK_SEARCHES[""]) + """ end[n + 1],
      concat_ws(' ', nullif(array_to_string(list_transform(deviations[1:4], lambda x: replace(x.marker, '_', ' ') || ' ' || left(x.finding, 120)), ' '), ''), nullif(array_to_string(list_transform(patterns[1:3], lambda x: replace(x.pattern, '-', ' ')), ' '), ''), left(prose, 240)))) as query
      from doc d left join risks r on r.pid = d.pid and r.day = d.day, (select unnest([0, 1]) as n) where warm""", {"risks": _RISK}),
}

SQL["session_tables"] = """with c as (select *, sha256((conv_id % 500)::varchar) as u from conversations), s as (select conv_id, any_value(u) as u, count(*) filter (turn % 2 = 1) as journals, arg_min(text, turn) as summary, list(role order by turn, role, text)[1:2] as roles,
  list({'title': role, 'place': turn} order by turn, role, text) filter (turn % 3 = 2) as changes from c group by conv_id)
select distinct 'users' as child, null::bigint as session, 0::bigint as n, u as content from c
union all select 'journal_sessions', conv_id, 0, md5(concat_ws('|', u, journals, summary)) from s
union all select 'wellbeing_assessments', conv_id, 0, case when conv_id % 2 = 0 then 'moderate' else 'mild' end || '|' || to_json(roles)::varchar || '|[]' from s where conv_id % 4 > 0
union all select 'recommendations', conv_id, row_number() over (partition by conv_id order by turn, role, text) - 1, md5(concat_ws('|', text, role)) from c where turn % 2 = 0
union all select 'raw_journals', conv_id, turn, md5(concat_ws('|', u, 'j' || (turn % 3), role, text)) from (select *, row_number() over (partition by u, turn % 3 order by conv_id, turn, role, text) as k from c where turn % 2 = 1 and turn % 5 > 0) where k = 1
union all select 'raw_journals', conv_id, turn, md5(concat_ws('|', u, role, text)) from c where turn % 2 = 1 and turn % 5 = 0
union all select 'calendar_proposals', conv_id, 0, to_json(changes)::varchar || '|false' from s where len(changes) > 0"""
