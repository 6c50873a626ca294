"""Hand-made cases with known answers, plan shapes, partition invariance, sources and batch against stream."""

import datetime as dt
import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from dayline.functions import columns as C
from dayline.functions import registry
from dayline.operators import baseline as B
from dayline.operators import calendar as K
from dayline.operators import device as D
from dayline.operators import evaluation as E
from dayline.operators import intervals as I
from dayline.operators import markers as M
from dayline.operators import memory as Y
from dayline.operators import outcomes as O
from dayline.operators import retrieval as R
from dayline.operators import stats as S
from dayline.operators import state as T
from dayline.plans import registry as plans
from dayline.sources import readers
from dayline.streaming import jobs

DAY = dt.date(2024, 5, 1)


def long_days(spark, values, marker="sleep_duration_hours"):
    rows = [("u1", DAY + dt.timedelta(days=i), i, marker, v, 1.0 if v is not None else 0.0) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "pid string, day date, day_num int, marker string, value double, coverage double")


def test_flat_history_has_the_floor_as_deviation(spark):
    s = B.baseline_stats(long_days(spark, [7.5] * 10), -20, 0).orderBy("day").collect()
    assert s[-1].std == 0.4 and s[-1].n == 10 and s[1].mean is None


def test_small_changes_are_no_deviation(spark):
    assert B.deviations(long_days(spark, [240.0] * 30 + [245.0] * 4, "total_screen_min")).count() == 0


def test_short_sleep_is_pronounced_and_sustained(spark):
    d = B.deviations(long_days(spark, [7.5] * 30 + [4.0] * 4)).orderBy("day").collect()[-1]
    assert (d.direction, d.magnitude, d.trajectory, d.z) == ("down", "pronounced", "sustained-4d", -8.75)


@pytest.mark.parametrize(
    ("zs", "want"),
    [([], "no-data"), ([1.2], "acute-1d"), ([0.5], "within-typical"), ([0.1, 0.2], "within-typical"), ([-2.0, -1.5], "sustained-2d"), ([0.2, 0.6, 1.1], "drift-emerging-3d"), ([-0.2, 0.1, 1.3], "acute-1d"), ([1.5, 0.2, 0.1], "intermittent-1d-of-3")],
)
def test_trajectories(spark, zs, want):
    assert spark.createDataFrame([(zs,)], "z array<double>").select(B.trajectory(F.col("z"))).first()[0] == want


def test_service_warms_up_later(spark):
    days = long_days(spark, [7.5] * 8).select("pid", "day")
    assert [r.warm for r in B.warmth(days, 3, 4).orderBy("day").collect()] == [False] * 6 + [True] * 2


def test_patterns_need_all_required_markers(spark):
    rows = [("u", DAY, "mobility_entropy", "mild", "down"), ("u", DAY, "location_revisit_ratio", "mild", "up"), ("u", DAY, "social_rhythm_metric", "mild", "down"), ("v", DAY, "mobility_entropy", "mild", "down"), ("w", DAY, "sleep_regularity_index", "mild", "down")]
    d = spark.createDataFrame(rows, "pid string, day date, marker string, magnitude string, direction string")
    got = {(r.pid, r.pattern): r.implicated for r in B.coherent_patterns(d).collect()}
    assert got == {("u", "behavioral-withdrawal"): ["mobility_entropy", "location_revisit_ratio", "social_rhythm_metric"], ("w", "circadian-instability"): ["sleep_regularity_index"]}
    assert {r.pid for r in B.coherent_patterns(d, 2).collect()} == {"u"}


def iv(spark, *pairs):
    t = lambda x: dt.datetime(2024, 5, 1) + dt.timedelta(seconds=x)
    return spark.createDataFrame([("u", t(a), t(b)) for a, b in pairs], "pid string, start timestamp_ntz, end timestamp_ntz")


def test_gaps_of_thirty_minutes_merge(spark):
    assert I.merge_intervals(iv(spark, (0, 600), (2400, 3000)), ["pid"]).count() == 1
    assert I.merge_intervals(iv(spark, (0, 600), (2401, 3000)), ["pid"]).count() == 2


def nights(spark, days):
    rows = [("u", DAY + dt.timedelta(days=i), dt.datetime.combine(DAY + dt.timedelta(days=i - 1), dt.time(23)), dt.datetime.combine(DAY + dt.timedelta(days=i), dt.time(7))) for i in days]
    return spark.createDataFrame(rows, "pid string, day date, start timestamp_ntz, end timestamp_ntz")


def test_regular_nights_score_100(spark):
    spine = spark.createDataFrame([("u", DAY + dt.timedelta(days=i)) for i in range(8)], "pid string, day date")
    got = M.sleep_regularity(nights(spark, range(8)), spine).orderBy("day").collect()
    assert got[-1].sri == 100 and got[0].sri is None and got[-1].coverage <= 0.75 + 1e-9
    assert M.sleep_regularity(nights(spark, [3]), spine).where("sri is not null").count() == 0


def test_regularity_equals_minute_arrays(spark):
    import random

    rng = random.Random(1)
    rows, known = [], {}
    for i in range(20):
        if rng.random() < 0.8:
            s = dt.datetime.combine(DAY + dt.timedelta(days=i - 1), dt.time(20)) + dt.timedelta(seconds=rng.randint(0, 25000))
            e = s + dt.timedelta(seconds=rng.randint(9000, 30000))
            rows.append(("u", DAY + dt.timedelta(days=i), s, e))
            known[i] = (s, e)
    zero = dt.datetime.combine(DAY - dt.timedelta(days=10), dt.time())
    asleep, valid = bytearray(60 * 1440), bytearray(60 * 1440)
    minute = lambda t: int((t - zero).total_seconds() // 60)
    for i, (s, e) in known.items():
        asleep[minute(s) : minute(e)] = b"\1" * (minute(e) - minute(s))
        a = minute(dt.datetime.combine(DAY + dt.timedelta(days=i - 1), dt.time(18)))
        valid[a : a + 1080] = b"\1" * 1080
    spine = spark.createDataFrame([("u", DAY + dt.timedelta(days=i)) for i in range(20)], "pid string, day date")
    got = {r.day: r.sri for r in M.sleep_regularity(spark.createDataFrame(rows, "pid string, day date, start timestamp_ntz, end timestamp_ntz"), spine).collect()}
    for i in range(20):
        a = minute(dt.datetime.combine(DAY + dt.timedelta(days=i - 6), dt.time()))
        both = [t for t in range(a, a + 7 * 1440) if valid[t] and valid[t - 1440]]
        want = 100 * sum(asleep[t] == asleep[t - 1440] for t in both) / len(both) if len(both) >= 2880 else None
        assert (got[DAY + dt.timedelta(days=i)] is None) == (want is None) and (want is None or abs(got[DAY + dt.timedelta(days=i)] - want) < 1e-9)


def test_mobility(spark):
    m = M.mobility(spark.createDataFrame([("u", DAY, "a", 300.0), ("u", DAY, "b", 100.0)], "pid string, day date, location string, secs double")).first()
    assert abs(m.entropy + 0.75 * math.log(0.75) + 0.25 * math.log(0.25)) < 1e-12
    top = M.mobility(spark.createDataFrame([("u", DAY, k, v) for k, v in zip("abcd", (50.0, 30.0, 10.0, 10.0), strict=True)], "pid string, day date, location string, secs double")).first()
    assert abs(top.revisit - 0.9) < 1e-12


def test_statistics(spark):
    one = spark.range(1)
    assert round(one.select(S.sign_test(F.lit(13), F.lit(22))).first()[0], 3) == 0.523
    # so many signs take as many steps, not their square
    assert round(one.select(S.sign_test(F.lit(270500), F.lit(540000))).first()[0], 4) == 0.174
    assert abs(one.select(S.t_tail(F.lit(2.228138851986), F.lit(10.0))).first()[0] - 0.05) < 1e-8
    df = spark.createDataFrame([(float(v), float(v)) for v in [0, 0, 1, 2] * 4], "x double, y double")
    assert abs(S.spearman(df, "x", "y").first().r - 1) < 1e-12


def test_a_state_document_computes_its_frames_once_in_one_shuffle(spark):
    from dayline.operators import state

    rows = [(p, DAY + dt.timedelta(days=i), m, float((i * 7 + (p or 0)) % 5 + (90 if i > 30 else 0)), 1.0 if i % 9 else 0.2) for p in (1, 2, None) for i in range(36) for m in ("sleep_onset_hour", "late_night_screen_min", "mobility_entropy", "own_marker")]
    long = spark.createDataFrame(rows, "pid long, day date, marker string, value double, coverage double").withColumn("day_num", F.datediff("day", F.lit("1970-01-01").cast("date")))
    doc = state.state_documents(long)
    plan = doc._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
    devs = B.deviations(long, 4, 21)
    days = B.warmth(long.where("pid is not null").select("pid", "day").distinct(), 10)
    key = lambda d, c: {(r.pid, r.day): r[c] for r in d.collect()}
    assert key(doc, "confidence") == key(state.overall_confidence(long.where("pid is not null"), devs), "confidence")
    assert key(state.risk_of_state(doc), "risk") == key(state.risk_level(devs.where("marker <> 'own_marker'"), B.coherent_patterns(devs), days), "risk")
    found = {(r.pid, r.day, r.pattern): r.implicated for r in B.coherent_patterns(devs).join(days.where("warm"), ["pid", "day"]).collect()}
    assert found == {(r.pid, r.day, p.pattern): p.implicated for r in doc.collect() for p in r.patterns or []} and found


def test_mixed_model_is_the_dense_maximum(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(g, float(x := rng.integers(0, 2)), float(1 + 0.7 * x + u + rng.normal())) for g in range(25) for u in [rng.normal()] for _ in range(8)]
    m = S.mixed_model(spark.createDataFrame(rows, "g int, x double, y double"), "g", "x", "y").first()
    tau, sigma = m.between, m.residual
    total = 0.0
    x = np.array([[1.0, r[1]] for r in rows])
    y, g = np.array([r[2] for r in rows]), np.array([r[0] for r in rows])
    v = np.where(g[:, None] == g[None, :], tau, 0) + sigma * np.eye(len(rows))
    inv = np.linalg.inv(v)
    beta = np.linalg.solve(x.T @ inv @ x, x.T @ inv @ y)
    res = y - x @ beta
    total = -0.5 * (len(rows) * np.log(2 * np.pi) + np.linalg.slogdet(v)[1] + res @ inv @ res)
    assert abs(m.loglik - total) < 1e-6 and abs(m.estimate - beta[1]) < 1e-8
    assert abs(m.se - np.sqrt(np.linalg.inv(x.T @ inv @ x)[1, 1])) < 1e-8


def test_bootstrap_ignores_partitions(spark):
    df = spark.createDataFrame([(i % 15, i % 3 == 0, float(i % 7)) for i in range(400)], "g int, f boolean, y double")
    for most in (200_000, 0):
        assert S.cluster_bootstrap(df, "g", "f", "y", 100, most=most).first() == S.cluster_bootstrap(df.repartition(9), "g", "f", "y", 100, most=most).first()


def test_drawn_counts_have_the_law_of_single_draws(spark):
    """Blocks of one replicate put together: as many draws as groups, means and variances of multinomial counts; the interval agrees with that of single draws."""
    import numpy as np

    groups, block = 103, 10
    counts = np.array([np.concatenate([S.drawn_counts(groups, block, p, rep, "s") for p in range(11)]) for rep in range(4000)])
    assert counts.shape == (4000, groups) and (counts.sum(axis=1) == groups).all()
    assert abs(counts.mean(axis=0) - 1).max() < 0.08 and abs(counts.var(axis=0) - (1 - 1 / groups)).max() < 0.15
    assert abs(np.cov(counts[:, 0], counts[:, 102])[0, 1] + 1 / groups) < 0.06
    df = spark.createDataFrame([(i % 60, (i * 7 + i % 60) % 3 == 0, float((i * 5 + i % 60) % 11)) for i in range(1200)], "g int, f boolean, y double")
    one, two = (S.cluster_bootstrap(df, "g", "f", "y", 2000, most=most).first() for most in (1000, 0))
    width = one.high - one.low
    assert one.reps == two.reps == 2000 and abs(one.low - two.low) < 0.1 * width and abs(one.high - two.high) < 0.1 * width


def test_proposals_may_touch_events_by_a_minute(spark):
    t = lambda h, m: dt.datetime(2024, 5, 1, h, m)
    e = spark.createDataFrame([("u", t(10, 0), t(11, 0))], "pid string, start timestamp_ntz, end timestamp_ntz")
    p = spark.createDataFrame([("u", "a", t(9, 30), t(10, 1), "add"), ("u", "b", t(9, 30), t(10, 2), "add"), ("u", "c", None, t(10, 2), "add"), ("u", "d", t(12, 0), t(12, 30), "delete")], "pid string, pkey string, start timestamp_ntz, end timestamp_ntz, action string")
    assert [r.pkey for r in K.drop_conflicts(p, e).collect()] == ["a"]


def test_three_assessments_are_not_enough_for_a_trend(spark):
    a = spark.createDataFrame([("u", "mild", i) for i in range(3)] + [("v", x, i) for i, x in enumerate(["mild", "mild", "severe", "severe", "severe"])], "user string, level string, place int")
    assert {r.user: r.trend for r in Y.risk_trend(a).collect()} == {"u": "insufficient_data", "v": "rising"}


def test_contained_places_make_one_segment(spark):
    t = lambda m: dt.datetime(2024, 5, 1, 9, m)
    rows = [(1, DAY, t(0), t(15), "still", "Cafe"), (1, DAY, t(15), t(30), "still", "Cafe North"), (1, DAY, t(30), t(45), "walk", "Cafe")]
    got = D.refine_segments(spark.createDataFrame(rows, "device int, day date, start timestamp_ntz, end timestamp_ntz, motion string, place string")).orderBy("start").collect()
    assert [(r.place, r.motion, r.end) for r in got] == [("Cafe North", "still", t(30)), ("Cafe", "walk", t(45))]


def test_findings_and_prose(spark):
    long = B.to_long(spark.createDataFrame([("u", DAY + dt.timedelta(days=i), {"x": 1.0}, *[float(7 if i < 30 else 3) if m == "sleep_duration_hours" else None for m in registry.NAMES]) for i in range(34)], "pid string, day date, coverage map<string,double>, " + ", ".join(f"{m} double" for m in registry.NAMES)))
    p = T.prose(T.state_documents(long)).orderBy("day").collect()
    assert "still learning" in p[0].prose and "nothing stands out" in p[20].prose and "nightly sleep is shorter: 3.0 h against a usual 7.0 h, on each of the last 4 days" in p[-1].prose


def test_column_helpers(spark):
    r = spark.range(1).select(C.clock(F.lit(23.999)), C.clock(F.lit(25.5)), C.minutes_of(F.lit("07:30")), C.shortened(F.lit("abcdef"), 5), D.grid_key(F.lit(0.0), F.lit(0.001)), R.judge_score(F.lit('x {"score": 1.7}')), R.judge_score(F.lit("none"))).first()
    assert tuple(r) == ("00:00", "01:30", 450, "ab...", "0:1", 1.0, None)


def test_interval_and_conflict_joins_are_equi_joins(spark):
    w = I.day_windows(spark.createDataFrame([("u", DAY)], "pid string, day date"), "4 hours", "28 hours")
    plan = I.clip_intervals(iv(spark, (0, 9)), w)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_results_do_not_depend_on_partitions(spark):
    d = long_days(spark, [7.0 + (i * 37 % 11) / 3 for i in range(60)])
    key = lambda df: sorted(map(str, df.collect()))
    assert key(B.deviations(d.repartition(1))) == key(B.deviations(d.repartition(64)))


def test_sources(spark):
    tmp = tempfile.mkdtemp()
    put = lambda name, text: open(os.path.join(tmp, name), "w", encoding="utf-8").write(text)
    put("lock_u07.csv", " start , end \n1364356801,1364357801\n5,5\nx,9\n")
    got = readers.read_intervals(spark, tmp + "/lock_u07.csv").collect()
    assert [(r.pid, r.start) for r in got] == [("u07", dt.datetime(2013, 3, 27, 0, 0, 1))]
    put("loc_u01.csv", "time,location\n1364356801,in[a],\n1364356802,,\n")
    assert [r.location for r in readers.read_locations(spark, tmp + "/loc_u01.csv").collect()] == ["in[a]"]
    put("app_u01.csv", "﻿id,timestamp,RUNNING_TASKS_topActivity_mPackage,more\n1,1364356801,com.x,z\n")
    assert [r.package for r in readers.read_apps(spark, tmp + "/app_u01.csv").collect()] == ["com.x"]
    put("sms_u01.csv", "MESSAGES_date,MESSAGES_type\n1364356801000,2\n1364356802000,1\n,1\n")
    assert [r.outgoing for r in readers.read_comm(spark, tmp + "/sms_u01.csv", "sms").orderBy("time").collect()] == [True, False]
    put("Stress_u01.json", '[{"level": "2", "resp_time": 1364356801}, {"level": "9"}]')
    a = readers.read_answers(spark, tmp + "/Stress_u01.json", ["level"])
    assert [(r.pid, r.stress) for r in O.stress_daily(a).collect()] == [("u01", 2.0)]
    put("f.jsonl", '{"action": "accept"}\nnot json\n')
    assert [r.action for r in readers.read_feedback(spark, tmp + "/f.jsonl").collect()] == ["accept"]
    logs = spark.createDataFrame([(1, 5, "battery", '{"level": 3}'), (2, 6, "battery", "{bad"), (3, 7, "x", "{}")], "id int, timestamp int, type string, content string")
    assert [r.level for r in readers.decode_logs(logs, "battery", "level int").collect()] == [3]


def streamed(spark, df, job, mode="append"):
    """Rows of a streaming job over `df` and one far later row that moves the watermark."""
    tmp = tempfile.mkdtemp()
    df.coalesce(1).write.parquet(tmp + "/in")
    name = "t" + os.path.basename(tmp).replace("-", "_")
    q = job(spark.readStream.schema(df.schema).parquet(tmp + "/in")).writeStream.format("memory").queryName(name).option("checkpointLocation", tmp + "/cp").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_stream_equals_batch(spark):
    t0 = dt.datetime(2024, 5, 1, 2)
    rows = [(i % 3, t0 + dt.timedelta(hours=7 * i), float(i)) for i in range(30)]
    df = spark.createDataFrame([*rows, (99, t0 + dt.timedelta(days=90), 0.0)], "pid int, ts timestamp, value double")
    batch = df.groupBy("pid", C.behavioural_day(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    key = lambda d: sorted((r.pid, r.day, r.n, r.total) for r in d.where("pid < 99").collect())
    assert key(streamed(spark, df, jobs.behavioural_days)) == key(batch)
    iv_ = spark.createDataFrame([(1, t0, t0 + dt.timedelta(minutes=10)), (1, t0 + dt.timedelta(minutes=40), t0 + dt.timedelta(minutes=50)), (1, t0 + dt.timedelta(minutes=80, seconds=1), t0 + dt.timedelta(minutes=90)), (9, t0 + dt.timedelta(days=9), t0 + dt.timedelta(days=9, minutes=1))], "pid int, start timestamp, end timestamp")
    got = streamed(spark, iv_, jobs.merged_sessions).where("pid = 1").orderBy("first").collect()
    assert [(r.first, r.last) for r in got] == [(t0, t0 + dt.timedelta(minutes=50)), (t0 + dt.timedelta(minutes=80, seconds=1), t0 + dt.timedelta(minutes=90))]


def test_every_query_with_sql_names_the_same_columns():
    assert set(plans.oracle_sql()) <= set(plans.queries())


def test_burden(spark):
    s = spark.createDataFrame([(1, "Cancel and move the run", "07:00", "07:20"), (1, None, None, None), (2, "rest", "09:00", "11:00")], "case_id int, change string, start_time string, end_time string")
    assert {r.case_id: (r.burden, r.high_burden) for r in E.burden_score(s).collect()} == {1: (2.5, True), 2: (1.2, False)}


def test_fixed_events_are_protected(spark):
    texts = spark.createDataFrame([(1, "Cancel the C++ (lab)?"), (2, "move lunch; the C++ lab stays " + "." * 60 + " gym"), (3, "  "), (4, None), (5, "sleep well"), (6, "a study block helps")], "case_id int, text string")
    plans = [(c, t, k, f) for c in (1, 2, 5) for t, k, f in [("Gym", "fitness", True), ("Lunch", "social_meal", False)]]
    plans += [(1, "C++ (lab", "lab", True), (6, None, None, None)]
    out = E.fixed_protection(texts, spark.createDataFrame(plans, "case_id int, title string, event_type string, fixed boolean")).collect()
    got = {r.case_id: (r.passed, r.touched) for r in out}
    assert got == {1: (False, ["C++ (lab"]), 2: (True, []), 3: (False, []), 4: (False, []), 5: (False, []), 6: (True, [])}


def test_levers_need_the_mechanism_or_evidence(spark):
    sleep = "phone-mediated-sleep-delay"
    rows = [(1, sleep, "put the Phone away", None, False), (2, sleep, "a wind-down", None, False), (3, sleep, "a wind-down", None, True), (4, sleep, "rest", "late_night_screen_min up", True), (5, sleep, "rest", "late_night_screen_min up", None), (6, "other", "phone", "x", True), (7, None, None, None, True)]
    df = spark.createDataFrame(rows, "i int, p string, t string, g string, e boolean")
    got = [r.c for r in df.select("i", E.lever_credit(F.col("p"), F.col("t"), F.col("g"), F.col("e")).alias("c")).orderBy("i").collect()]
    assert got == [True, False, True, True, False, False, False]


def test_only_the_informed_arm_has_evidence(spark):
    cases = spark.createDataFrame([(1, 7, 1, "p"), (2, 8, 1, "p")], "case_id int, pid int, day int, pattern string")
    states = spark.createDataFrame([(7, 1, ["q"], ["p", "q"])], "pid int, day int, early array<string>, later array<string>")
    loads = spark.createDataFrame([(7, 1, 2)], "pid int, day int, events int")
    results = spark.createDataFrame([(c, a) for c in (1, 2) for a in ("aware", "plain")], "case_id int, arm string")
    got = {(r.case_id, r.arm): (r.names, r.detected, r.evidence, r.events) for r in E.decision_cases(cases, states, loads, results, "aware").collect()}
    assert got[1, "aware"] == (["p", "q"], True, True, 2) and got[1, "plain"] == (["p", "q"], True, False, 2)
    assert got[2, "aware"] == ([], False, False, None)


def test_raw_records_have_their_own_windows(spark):
    days = spark.sql("select 1 pid, date'2024-01-02' day")
    spans = spark.sql("select 'lock' stream, 1 pid, timestamp_ntz'2024-01-01 19:00:00' start, explode(array(timestamp_ntz'2024-01-01 20:00:00', timestamp_ntz'2024-01-01 20:01:00', timestamp_ntz'2024-01-09 00:00:00')) `end`").withColumn("record", F.col("end").cast("string"))
    points = spark.sql("select 'app' stream, 1 pid, explode(array(timestamp_ntz'2024-01-02 03:59:59', timestamp_ntz'2024-01-02 04:00:00', timestamp_ntz'2024-01-03 03:59:59', timestamp_ntz'2024-01-03 04:00:00')) ts").withColumn("record", F.col("ts").cast("string"))
    got = {r.stream: (r.n, r.records) for r in I.raw_records(days, spans, points).collect()}
    assert got == {"lock": (2, ["2024-01-01 20:01:00", "2024-01-09 00:00:00"]), "app": (2, ["2024-01-02 04:00:00", "2024-01-03 03:59:59"])}


def test_device_days_without_a_source_have_no_coverage(spark):
    contexts = spark.createDataFrame([("d", 1, "a", 21600, 8.0), ("d", 1, "b", 0, None), ("d", 2, "a", 43200, None), ("d", 3, None, 0, 9.5)], "device string, day int, place string, secs long, active_hour double")
    nights = spark.sql("select 'd' device, 4 day, timestamp_ntz'2024-01-04 01:30:00' start, 6.5d hours, 0.4d coverage")
    comm = spark.createDataFrame([("d", 1, 1, 3, 0.5), ("d", 2, 0, 0, 1.0)], "device string, day int, incoming long, outgoing long, coverage double")
    got = {r.day: (r.markers, r.coverage) for r in D.marker_days(contexts, nights, comm).collect()}
    assert set(got) == {1, 2, 3, 4}
    markers, coverage = got[1]
    assert abs(markers["mobility_entropy"]) < 1e-12 and markers["location_revisit_ratio"] == 1.0 and markers["social_rhythm_metric"] == 0.5 and markers["comm_reciprocity"] == 0.75
    assert coverage["mobility_entropy"] == 0.5 and coverage["comm_reciprocity"] == 0.5 and coverage["sleep_onset_hour"] == 0.0
    assert got[2][0]["social_rhythm_metric"] is None and got[2][0]["comm_reciprocity"] is None
    assert got[3][0]["mobility_entropy"] is None and got[3][1]["mobility_entropy"] == 0.0
    assert got[2][1]["comm_reciprocity"] == 0.0 and got[4][1]["sleep_onset_hour"] == got[4][1]["sleep_duration_hours"] == 0.4
    assert got[4][0]["sleep_onset_hour"] == 25.5 and got[4][0]["sleep_duration_hours"] == 6.5 and got[4][0]["mobility_entropy"] is None


def test_vector_searches_equal_brute_force(spark):
    """Exact in one block or in many, in one batch or in several; approximate over many cells, one of them hot, with the recall asked for."""
    import numpy as np

    from dayline.operators import retrieval

    rng = np.random.default_rng(8)
    v = rng.normal(size=(900, 12))
    v[:300] = v[0] + rng.normal(size=(300, 12)) * 0.05
    v[5] = v[6]
    u = v / np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, [float(x) for x in e], i % 3) for i, e in enumerate(v)] + [(2000, None, 1), (2001, [0.0] * 12, 1), (2002, [float("nan")] * 12, 1)]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>, kind int")
    queries = corpus.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    cos = np.round(u @ u.T, 9)

    def want(i, kind=None):
        can = [j for j in range(900) if j != i and (kind is None or j % 3 == kind)]
        return sorted(can, key=lambda j: (-cos[i, j], j))[:5]

    for block in (16_384, 7):
        got = retrieval.vector_topk(queries, corpus, 5, skip_self=True, block=block).collect()
        assert {(r.query_id, r.place): r.id for r in got} == {(i, p + 1): j for i in range(0, 900, 20) for p, j in enumerate(want(i))}
    got = retrieval.vector_topk(queries, corpus, 5, same="kind", skip_self=True).collect()
    assert {(r.query_id, r.place): r.id for r in got} == {(i, p + 1): j for i in range(0, 900, 20) for p, j in enumerate(want(i, i % 3))}
    got = retrieval.vector_topk(queries, corpus, 5, same="kind", skip_self=True, block=11).collect()
    assert {(r.query_id, r.place): r.id for r in got} == {(i, p + 1): j for i in range(0, 900, 20) for p, j in enumerate(want(i, i % 3))}
    index = retrieval.CellIndex.fit(corpus, 60)
    assert len(index.centres) == 15 and index.sizes.agg(F.sum("n")).first()[0] == 900
    probes = index.probes_for(queries, 5, 0.95, skip_self=True)
    work = [r.compared for r in index.work(queries, probes).collect()]
    assert len(work) == 45 and sum(work) < 0.8 * 45 * 900
    assert sorted(map(tuple, index.search(queries, 5, len(index.centres), skip_self=True, part=50).collect())) == sorted(map(tuple, retrieval.vector_topk(queries, corpus, 5, skip_self=True).collect()))
    assert retrieval.vector_topk_lsh(queries, corpus.limit(0), 5).count() == 0 and retrieval.vector_topk_lsh(queries.limit(0), corpus, 5).count() == 0
    near = retrieval.vector_topk_lsh(queries, corpus, 5, skip_self=True, cell=60, part=50).collect()
    found = {(r.query_id, r.id) for r in near}
    assert len(found) == len(near) and sum((i, j) in found for i in range(0, 900, 20) for j in want(i)) >= 0.9 * 45 * 5
    assert retrieval.vector_topk(queries.limit(0), corpus, 5).count() == 0 and retrieval.vector_topk(queries, corpus.limit(0), 5).count() == 0


def test_nearest_cells_come_in_batches_that_dont_grow_with_the_centres():
    import numpy as np
    import pyarrow as pa

    from dayline.operators import retrieval

    rng = np.random.default_rng(3)
    v, centres = rng.normal(size=(700, 4)), retrieval._units(rng.normal(size=(900, 4)))
    batch = pa.record_batch([pa.array(range(720)), pa.array([[1.0] * 4] * 20 + v.tolist())], ["id", "vector"]).slice(20)
    want = np.argsort(-(retrieval._units(v) @ centres.T), axis=1, kind="stable")
    for probes in (1, 3, 900):
        for vectors in (True, False):
            out = list(retrieval._cells_of(centres, probes, vectors)(iter([batch])))
            assert max(b.num_rows for b in out) <= max(1 << 16, probes)
            got = pa.Table.from_batches(out)
            assert got.column_names == (["id", "vector", "cell"] if vectors else ["id", "cell"])
            assert got.column("id").to_pylist() == np.repeat(range(20, 720), probes).tolist() and got.column("cell").to_pylist() == want[:, :probes].ravel().tolist()
    orders = pa.Table.from_batches(retrieval._orders(centres)(iter([batch])))
    assert orders.column("id").to_pylist() == list(range(20, 720)) and orders.column("order").to_pylist() == want.tolist()


def test_fuzzy_match_equals_brute_force(spark):
    import random

    from dayline.operators import retrieval

    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)] + ["the"] * 15
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))
    files, titles = [(i, name()) for i in range(150)] + [(900, ""), (901, None)], [(i, name()) for i in range(60)]
    got = {r.file_id: (r.title_id, round(r.score, 9)) for r in retrieval.fuzzy_match(spark.createDataFrame(files, "file_id long, name string"), spark.createDataFrame(titles, "title_id long, title string"), 0.5).collect()}
    want = {}
    for i, n in files:
        a = set((n or "").split())
        scores = [(-len(a & set(t.split())) / len(a), j) for j, t in titles] if a else []
        if scores and -min(scores)[0] >= 0.5:
            want[i] = (min(scores)[1], round(-min(scores)[0], 9))
    assert got == want


def test_running_total_by_ranges(spark):
    from dayline.functions.staging import running_total

    df = spark.createDataFrame([(float(i * 7 % 101), i % 5) for i in range(101)], "v double, c long").repartition(6)
    want, total = {}, 0
    for v, c in sorted((float(i * 7 % 101), i % 5) for i in range(101)):
        want[v] = total
        total += c
    for most in (1000, 10):
        assert {r.v: r.before for r in running_total(df, "v", "c", "before", most).collect()} == want


def test_times_of_clients_and_broken_payloads(spark):
    from dayline.functions import columns as C
    from dayline.sources import readers

    rows = [("2024-03-01T10:00:00Z", "America/New_York"), ("2024-03-01T10:00:00", "America/New_York"), ("2024-07-01T10:00:00+02:00", "Europe/Berlin"), ("2024-03-01T10:00:00z", "No/Where"), ("soon", "UTC"), (None, None)]
    got = [str(r[0]) for r in spark.createDataFrame(rows, "t string, z string").select(C.iso_local(F.col("t"), F.col("z"))).collect()]
    assert got == ["2024-03-01 05:00:00", "2024-03-01 10:00:00", "2024-07-01 10:00:00", "2024-03-01 10:00:00", "None", "None"]
    assert spark.range(1).select(C.minutes_of(F.lit("9:30")), C.minutes_of(F.lit("09:30")), C.json_object(F.lit('```json\n{"a": 1}\n```')), C.json_object(F.lit("none"))).first()[:] == (None, 570, '{"a": 1}', None)
    logs = [(1, "sleep_state", '{"event": "screen_off", "ts": 1700000000000, "lux": 3.5}'), (2, "sleep_state", 'x "event":"screen_on" "ts":1700000060000'), (3, "sleep_state", "{}"), (4, "context", '{"event": "a", "ts": 1}')]
    d = {r.id: (r.event, r.lux) for r in readers.decode_sleep_states(spark.createDataFrame(logs, "id long, type string, content string")).collect()}
    assert d == {1: ("screen_off", 3.5), 2: ("screen_on", None)}


def test_open_pair_is_closed_by_timer(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = lambda h: dt.datetime(2024, 5, 1, 20) + dt.timedelta(hours=h)
    rows = [(1, at(0), 0, True, 3.0), (1, at(1), 1, True, 5.0), (1, at(9), 2, False, None), (2, at(2), 3, True, None), (3, at(0), 4, False, None), (9, at(480), 5, False, None)]
    df = spark.createDataFrame(rows, "device long, ts timestamp, seq long, off boolean, lux double")
    got = [tuple(r) for r in streamed(spark, df, jobs.pair_on_off).orderBy("device").collect()]
    assert got == [(1, at(1), at(9), 5.0), (2, at(2), at(26), None)]


def test_field_paths_and_fixed(spark):
    docs = spark.createDataFrame([('{"a": {"b": [1, {"c": 2}]}}',), ('{"a": 3, "d": []}',), ("not json",), (None,)], "doc string")
    assert {tuple(r) for r in T.field_paths(docs, "doc").collect()} == {("a", 2), ("a.b", 1), ("a.b[]", 2), ("a.b[].c", 1), ("d", 1)}
    assert T.field_paths(docs.where("false"), "doc").count() == 0
    odd = spark.createDataFrame([('{"a": 1, "a": 2}',), ("NaN",), ("[[1, [2]], {}]",), ('"x"',), ("",), ('{"a.b": {"": null}}',), ("[" * 3000 + "]" * 3000,)], "doc string")
    assert {tuple(r) for r in T.field_paths(odd, "doc").where("length(path) < 20").collect()} >= {("[][]", 3), ("[][][]", 2), ("a.b", 1), ("a.b.", 1)}
    assert T.field_paths(docs, "doc")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    x = spark.createDataFrame([(2.5,), (0.285,), (-0.0,), (None,)], "x double").select(T.fixed(F.col("x"), 0), T.fixed(F.col("x"), 2)).collect()
    assert [tuple(r) for r in x] == [("3", "2.50"), ("0", "0.29"), ("0", "0.00"), (None, None)]


def test_mixed_models_by_label_equal_single_ones(spark):
    rows = [(label, g, (g + i) % 2, float((g * 7 + i * 3 + len(label)) % 5)) for label in ("a", "bb") for g in range(6) for i in range(5)]
    df = spark.createDataFrame(rows, "label string, g long, x int, y double")
    both = {r.label: r.asDict() for r in S.mixed_model(df, "g", "x", "y", by=("label",)).collect()}
    for label, r in both.items():
        one = S.mixed_model(df.where(F.col("label") == label), "g", "x", "y").first().asDict()
        assert all(abs(one[k] - r[k]) < 1e-9 for k in one)
    assert len(both) == 2 and S.mixed_model(df.where("false"), "g", "x", "y").count() == 0


def test_session_tables(spark, tmp_path):
    doc = '{"journal_summary": "s", "wellbeing": {"risk_level": "mild"}, "recommendations": [{"action": "walk", "when_to_do": "pm"}], "journals": [{"id": "j1", "content": "x"}, {"id": "", "content": "y"}], "proposed_changes": [{"title": "t"}]}'
    s = spark.createDataFrame([("s1", "u", doc), ("s2", "u", doc), ("s3", "v", "broken"), ("s4", "v", None)], "session string, user string, doc string")
    for part in (s, s.where("session = 's3'")):
        Y.write_sessions(part, str(tmp_path / "w"))
    sizes = {p.name: spark.read.parquet(str(p)).count() for p in (tmp_path / "w").iterdir()}
    assert sizes == {"users": 2, "journal_sessions": 5, "wellbeing_assessments": 2, "recommendations": 2, "raw_journals": 3, "calendar_proposals": 2}


def test_a_night_is_covered_as_far_as_its_events_reach(spark):
    t = lambda day, h: dt.datetime(2024, 5, day, h)
    pairs = spark.createDataFrame([(1, t(1, 23), t(2, 0), 1.0), (2, t(1, 23), t(2, 7), 1.0), (3, t(1, 10), t(3, 15), 1.0)], "device long, start timestamp_ntz, end timestamp_ntz, lux double")
    events = spark.createDataFrame([(1, t(1, 23)), (1, t(2, 0)), (1, t(2, 13)), (2, t(1, 18)), (2, t(1, 20)), (2, t(2, 7)), (2, t(2, 11)), (3, t(1, 10)), (3, t(3, 15))], "device long, ts timestamp_ntz")
    nights = D.night_episode(pairs, events)
    got = {(r.device, r.day.day): (r.hours, round(r.coverage * 17, 6)) for r in nights.collect()}
    # one dark hour seen; a night seen from 20:00 to 11:00; nights without an event, spanned by one stretch
    assert got == {(1, 2): (1.0, 1.0), (2, 2): (8.0, 15.0), (3, 1): (2.0, 0.0), (3, 2): (17.0, 17.0), (3, 3): (17.0, 17.0)}
    contexts = spark.createDataFrame([], "device long, day date, place string, secs long, active_hour double")
    comm = spark.createDataFrame([(1, dt.date(2024, 5, d), 1, 1, 0.5) for d in (2, 3, 4, 5)], "device long, day date, incoming long, outgoing long, coverage double")
    days = {(r.device, r.day.day): r.coverage for r in D.marker_days(contexts, nights, comm).collect()}
    assert round(days[1, 2]["sleep_onset_hour"] * 17, 6) == 1.0 and days[1, 2]["sleep_regularity_index"] == 0.0 and days[1, 3]["comm_reciprocity"] == 0.5
    assert days[3, 2]["sleep_regularity_index"] == 1.0 and days[3, 1]["sleep_duration_hours"] == 0.0


def test_battery_and_map_labels(spark):
    runs = spark.createDataFrame([("p", "baseline", 1.0, 40, 1), ("p", "active", 7.0, 50, 2), ("q", "active", 9.0, 50, 3), ("q", "baseline", 1.0, 20, 2)], "platform string, profile string, per_hour double, minutes int, place int")
    pairs = D.battery_pairs(runs)
    assert {tuple(r) for r in pairs.collect()} == {("p", True, 6.0, "notable", "full"), ("q", False, None, "notable", None)}
    short = spark.createDataFrame([("p", "baseline", 1.0, 20, 1), ("p", "active", 1.5, 31, 2)], runs.schema)
    assert tuple(D.battery_pairs(short).first()) == ("p", True, 0.5, "minimal", "short")
    assert tuple(D.battery_impact(pairs).first()) == (2, "notable") and tuple(D.battery_impact(pairs.where("false")).first()) == (0, "unknown")
    tags = spark.createDataFrame([(1, i, t) for i, t in enumerate([{"amenity": "bench", "building": "yes", "name": "Hall"}, {"leisure": "park"}, {"building": " "}, {"building": "no"}, {}])] + [(2, 0, None)], "k int, place int, tags map<string, string>")
    assert [tuple(r) for r in D.feature_summary(tags, ["k"]).collect()] == [(1, "Nearby map features: buildings, green space. Named places/features: Hall")]


def test_a_slot_is_not_multiplied_by_the_days_it_may_take(spark):
    at = lambda day, hour: dt.datetime.combine(DAY + dt.timedelta(days=day), dt.time(hour))
    events = spark.createDataFrame([(1, at(1, 9), at(1, 11)), (1, at(2, 22), at(4, 12)), (2, at(1, 0), at(30, 0)), (1, None, at(9, 0))], "pid long, start timestamp_ntz, end timestamp_ntz")
    slots = spark.createDataFrame([(1, 1, DAY, 600, 30), (2, 2, DAY, 600, 30), (3, 1, DAY, 1430, 30), (4, 3, DAY, 600, 30), (5, 1, DAY, None, 30)], "skey long, pid long, today date, minute int, minutes int")
    out = K.first_free_day(slots, events)
    assert {r.skey: (r.free_day - DAY).days for r in out.collect()} == {1: 2, 2: 1, 3: 1, 4: 1, 5: 1}
    assert "LeftAnti" not in out._jdf.queryExecution().optimizedPlan().toString()  # slots times days against their conflicts
