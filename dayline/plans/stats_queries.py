"""Queries of self-report outcomes and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayline.functions import registry
from dayline.functions.staging import staged
from dayline.operators import baseline as B
from dayline.operators import outcomes as O
from dayline.operators import stats as S
from dayline.plans.fixtures import events, marker_long, with_

R, N, WARM = 4, 21, 10
r6 = lambda *cs: [F.round(c, 6).alias(c) for c in cs]


def _answers(spark: SparkSession, d: str, kind: str, **cols) -> DataFrame:
    return events(spark, d).where(F.col("kind") == kind).select("pid", "day", "ts", *[v.alias(k) for k, v in cols.items()])


def _stress(spark, d):
    return O.stress_daily(_answers(spark, d, "error", level=F.col("k") % 7))


def _pam(spark, d):
    return O.pam_daily(_answers(spark, d, "view", picture_idx=F.col("k") % 20))


def _sleep(spark, d):
    return O.sleep_answers_daily(_answers(spark, d, "signup", hour=F.col("k") % 22, rate=F.col("k") % 6))


def q_stress_daily(spark: SparkSession, d: str) -> DataFrame:
    return _stress(spark, d).select("pid", "day", *r6("stress"))


def q_pam_daily(spark: SparkSession, d: str) -> DataFrame:
    return _pam(spark, d).select("pid", "day", *r6("valence", "arousal"))


def q_sleep_ema_daily(spark: SparkSession, d: str) -> DataFrame:
    return _sleep(spark, d).select("pid", "day", *r6("sleep_hours", "sleep_quality"))


def q_response_timing(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).where("kind in ('error', 'view', 'signup')").withColumn("hour", F.hour("ts") + F.minute("ts") / 60)
    return e.groupBy("kind").agg(*O.response_timing(F.col("hour"))).select("kind", "n", *r6("median", "p10", "p90", "before_noon_pct"))


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _stress(spark, d).join(_pam(spark, d), ["pid", "day"], "full").join(_sleep(spark, d), ["pid", "day"], "full")


OUTCOMES = ["stress", "valence", "sleep_hours", "sleep_quality"]


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    days = marker_long(spark, d).select("pid", "day").distinct()
    return O.align(days, _outcomes(spark, d), OUTCOMES, ("valence", "sleep_hours"))


ALIGNED = [f"{c}_{w}" for c in OUTCOMES for w in ("same", "next")]


def q_outcome_alignment(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d).select("pid", "day", *r6(*ALIGNED))


def q_ema_coverage(spark: SparkSession, d: str) -> DataFrame:
    long = _aligned(spark, d).unpivot(["pid", "day"], ALIGNED, "outcome", "v").where("v is not null")
    return long.groupBy("outcome").agg(F.count(F.lit(1)).alias("days"), F.count_distinct("pid").alias("people"))


def with_flags(daily: DataFrame) -> DataFrame:
    """Pattern flags, and whether anything deviated."""
    names = F.split("pattern_names", r"\|")
    out = daily
    for p in registry.PATTERNS:
        out = out.withColumn(p.replace("-", "_"), F.array_contains(names, p))
    return out.withColumn("any_pattern", F.col("n_pat") > 0).withColumn("any_deviation", F.col("n_dev") > 0)


FLAGS = [p.replace("-", "_") for p in registry.PATTERNS] + ["any_pattern", "any_deviation"]


def _joined(spark: SparkSession, d: str) -> DataFrame:
    daily = B.daily_pipeline(marker_long(spark, d), WARM, R, N).where("warm")
    return staged(with_flags(daily).join(_stress(spark, d), ["pid", "day"], "left"), "labelled-days")


def q_pattern_flags(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d).select("pid", "day", *FLAGS)


def _confident(spark: SparkSession, d: str) -> DataFrame:
    """Least coverage of each pattern's required markers on a day, and whether a pattern that fired reaches 0.45."""
    long = marker_long(spark, d)
    need = registry.rule_table(spark).where("required").select("pattern", "marker")
    low = long.join(F.broadcast(need), "marker").groupBy("pid", "day", "pattern").agg(F.min("coverage").alias("least"))
    wide = low.groupBy("pid", "day").agg(F.min("least").alias("any_least"), F.collect_list(F.when(F.col("least") >= 0.45, F.col("pattern"))).alias("covered"))
    j = _joined(spark, d).join(wide, ["pid", "day"])
    hit = F.array_intersect(F.split("pattern_names", r"\|"), "covered")
    return j.withColumn("confident", F.array_join(F.array_sort(hit), "|")).withColumn("any_confident", F.size(hit) > 0)


def q_confident_patterns(spark: SparkSession, d: str) -> DataFrame:
    return _confident(spark, d).select("pid", "day", *r6("any_least"), "confident", "any_confident")


def _tests(spark: SparkSession, d: str) -> DataFrame:
    return S.binary_outcomes(_joined(spark, d), {c: F.col(c) for c in FLAGS}, "stress")


def q_binary_outcome(spark: SparkSession, d: str) -> DataFrame:
    return _tests(spark, d).select("label", "n_yes", "n_no", *r6("mean_yes", "mean_no", "diff"))


def q_cohen_d(spark: SparkSession, d: str) -> DataFrame:
    return _tests(spark, d).select("label", *r6("cohen_d"))


def q_welch_test(spark: SparkSession, d: str) -> DataFrame:
    return _tests(spark, d).select("label", *r6("t", "df", "p"))


def q_spearman_pooled(spark: SparkSession, d: str) -> DataFrame:
    return S.spearman(_joined(spark, d), "risk_index", "stress").select("n", *r6("r", "p"))


def q_spearman_by_person(spark: SparkSession, d: str) -> DataFrame:
    s = S.spearman_by_group(_joined(spark, d), "pid", "n_dev", "stress", 3)
    return s.agg(F.count(F.lit(1)).alias("people"), F.percentile("r", F.lit(0.5)).alias("median"), F.avg("r").alias("mean"), (100 * F.avg((F.round("r", 9) > 0).cast("int"))).alias("positive_pct")).select("people", *r6("median", "mean", "positive_pct"))


def q_exemplar(spark: SparkSession, d: str) -> DataFrame:
    s = S.spearman_by_group(_joined(spark, d), "pid", "n_dev", "stress", 3)
    return s.select("pid", "n", *r6("r")).orderBy(F.col("r").desc(), "pid").limit(1)


def q_cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return S.cluster_bootstrap(_joined(spark, d), "pid", "any_pattern", "stress").select("reps", *r6("low", "high"))


def q_cluster_bootstrap_counts(spark: SparkSession, d: str) -> DataFrame:
    """The interval by drawn counts, as for more people than travel to all tasks: other draws of the same law."""
    return S.cluster_bootstrap(_joined(spark, d), "pid", "any_pattern", "stress", most=0).select("reps", *r6("low", "high"))


def q_within_person(spark: SparkSession, d: str) -> DataFrame:
    return S.within_person(_joined(spark, d), "pid", "any_deviation", "stress").select("n", "n_positive", *r6("median_diff", "mean_diff", "percent_positive", "p"))


def q_ablation(spark: SparkSession, d: str) -> DataFrame:
    j = _confident(spark, d)
    flags = {c: F.col(c) for c in ("any_deviation", "any_pattern", "any_confident")}
    t = S.binary_outcomes(j, flags, "stress").select("label", F.col("n_yes").alias("n"), F.col("diff").alias("effect"), "p")
    for x in ("n_dev", "n_pat", "risk_index"):
        t = t.unionByName(S.spearman(j, x, "stress").select(F.lit(x).alias("label"), "n", F.col("r").alias("effect"), "p"))
    return t.select("label", "n", *r6("effect", "p"))


def q_marker_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = F.coalesce("coverage", F.lit(0.0))
    pct = lambda x: 100 * F.avg(x.cast("int"))
    return marker_long(spark, d).groupBy("marker").agg(F.avg(c).alias("mean_coverage"), pct(c > 0).alias("any_pct"), pct(c >= 0.45).alias("medium_pct"), pct(c >= 0.75).alias("high_pct")).select("marker", *r6("mean_coverage", "any_pct", "medium_pct", "high_pct"))


def q_mixed_model(spark: SparkSession, d: str) -> DataFrame:
    m = S.mixed_model(_joined(spark, d).withColumn("x", F.col("any_deviation").cast("int")), "pid", "x", "stress")
    return m.select("groups", F.col("rows").cast("long").alias("rows"), *r6("estimate", "se", "loglik", "lrt"), *[F.round(c, 5).alias(c) for c in ("p", "lrt_p")], *[F.round(c, 4).alias(c) for c in ("residual", "icc")])


def q_construct_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Each state against each outcome and alignment, larger meaning worse."""
    daily = with_flags(B.daily_pipeline(marker_long(spark, d), WARM, R, N).where("warm"))
    a = daily.join(_aligned(spark, d), ["pid", "day"])
    long = a.unpivot(["pid", "day", *FLAGS], ALIGNED, "outcome", "y").where("y is not null").unpivot(["pid", "outcome", "y"], FLAGS, "state", "flag")
    s = long.groupBy("state", "outcome").agg(F.count_if("flag").alias("n_yes"), F.count_if(~F.col("flag")).alias("n_no"), (F.avg(F.when(F.col("flag"), F.col("y"))) - F.avg(F.when(~F.col("flag"), F.col("y")))).alias("diff"))
    return s.select("state", "outcome", "n_yes", "n_no", *r6("diff"))


#: The survey's outcomes in the terms of the derived ones.
TERMS = {"sleep_hours": "sleep_hours", "sleep_quality": "sleep_quality", "stress_severity": "stress", "pam_valence": "valence"}
PAIRINGS = [(state, role + ("" if when == "same" else "_NEXT_NIGHT_ALIGNMENT"), TERMS[outcome], when) for state, role, outcome, later in registry.CONSTRUCTS for when in (("same", "next") if later else ("same",))]


def _paired(spark: SparkSession, d: str) -> DataFrame:
    daily = with_flags(B.daily_pipeline(marker_long(spark, d), WARM, R, N).where("warm"))
    a = daily.join(_aligned(spark, d), ["pid", "day"])
    turned = lambda c, when: F.col(f"{c}_{when}") * (-1 if c in ("valence", "sleep_hours") else 1)
    rows = [F.struct(F.lit("/".join((state, role, c, when))).alias("label"), F.col(state.replace("-", "_")).alias("flag"), F.col(f"{c}_{when}").cast("double").alias("y"), turned(c, when).cast("double").alias("raw")) for state, role, c, when in PAIRINGS]
    return a.select("pid", F.explode(F.array(*rows)).alias("r")).select("pid", "r.*")


def q_construct_table(spark: SparkSession, d: str) -> DataFrame:
    """The stated pairs of state, outcome and alignment with all their tests."""
    t = S.construct_table(_paired(spark, d))
    exact = ["n_yes", "n_no", "yes_people", "people", "ranked_people"]
    return t.select("label", *exact, *r6("mean_yes", "mean_no", "raw_mean_yes", "raw_mean_no", "welch_p", "cohen_d", "positive_pct"), (F.round("median_r", 6) + 0.0).alias("median_r"), *[F.round(c, 4).alias(c) for c in ("mixed_estimate", "mixed_se", "mixed_p", "mixed_icc", "mixed_lrt_p")])


def q_risk_above_median(spark: SparkSession, d: str) -> DataFrame:
    j = _joined(spark, d).where("stress is not null")
    middle = j.agg(F.percentile("risk_index", F.lit(0.5)).alias("m"))
    return S.binary_outcomes(j.join(F.broadcast(middle)), {"above": F.col("risk_index") > F.col("m")}, "stress").select("label", "n_yes", "n_no", *r6("diff", "p"))


def q_risk_histogram(spark: SparkSession, d: str) -> DataFrame:
    band = F.when(F.col("stress") >= 2, "high").when(F.col("stress") <= 1, "low").otherwise("mid")
    h = _joined(spark, d).where("stress is not null").groupBy(band.alias("band"), F.floor("risk_index").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return h.withColumn("density", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("band")), 6))


def q_cohort_summary(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d).agg(F.count(F.lit(1)).alias("warm_days"), F.count_distinct("pid").alias("people"), F.count("stress").alias("labelled_days"), F.count_if("any_pattern").alias("pattern_days"))


def q_bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    long = _joined(spark, d).unpivot(["pid", "stress"], FLAGS, "bucket", "flag").where("flag")
    return long.groupBy("bucket").agg(F.count(F.lit(1)).alias("fires"), F.count("stress").alias("labelled"), F.count_distinct("pid").alias("people"))


def q_predictor_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Every flag by Welch's test and every number by rank correlation, in one table."""
    j = _joined(spark, d)
    t = S.binary_outcomes(j, {c: F.col(c) for c in FLAGS}, "stress").select("label", F.lit("welch").alias("test"), F.col("diff").alias("effect"), "p")
    for x in ("n_dev", "n_pat", "risk_index", "n_markers_present"):
        t = t.unionByName(S.spearman(j, x, "stress").select(F.lit(x).alias("label"), F.lit("spearman").alias("test"), F.col("r").alias("effect"), "p"))
    return t.select("label", "test", *r6("effect", "p"))


QUERIES = {k[2:]: v for k, v in globals().items() if k.startswith("q_")}

_EXTRA = {
    "stress": "select pid, day, avg(greatest(0, 4 - k % 7))::double as stress from ev where kind = 'error' and k % 7 between 1 and 5 group by all",
    "pam": "select pid, day, avg((k % 20 - 1) % 4 + 1) as valence, avg((k % 20 - 1) // 4 + 1) as arousal from ev where kind = 'view' and k % 20 between 1 and 16 group by all",
    "slept": "select * from (select pid, day, avg(case when k % 22 = 1 then 2.5 when k % 22 between 2 and 19 then k % 22 + 1.5 end)::double as sleep_hours, avg(case when k % 6 between 1 and 4 then k % 6 end) as sleep_quality from ev where kind = 'signup' group by all) where sleep_hours is not null or sleep_quality is not null",
    "outcomes": "select * from stress full join pam using (pid, day) full join slept using (pid, day)",
    "flagged": "select *, " + ", ".join(f"list_contains(string_split(pattern_names, '|'), '{p}') as {p.replace('-', '_')}" for p in registry.PATTERNS) + ", n_pat > 0 as any_pattern, n_dev > 0 as any_deviation from daily where warm",
    "joined": "select f.*, s.stress from flagged f left join stress s on f.pid = s.pid and f.day = s.day",
    "aligned": "select h.pid, h.day, " + ", ".join(f"{'-' if c in ('valence', 'sleep_hours') else ''}{t}.{c} as {c}_{n}" for c in OUTCOMES for t, n in (("a", "same"), ("b", "next"))) + " from history h left join outcomes a on a.pid = h.pid and a.day = h.day left join outcomes b on b.pid = h.pid and b.day = h.day + 1",
    "least": "select l.pid, l.day, pattern, min(coverage) as least from long l join rules r on r.marker = l.marker and r.required group by all",
    "conf": "select j.*, w.any_least, list_sort(list_filter(w.covered, lambda x: list_contains(string_split(j.pattern_names, '|'), x))) as hit from joined j join (select pid, day, min(least) as any_least, list(pattern) filter (least >= 0.45) as covered from least group by all) w on j.pid = w.pid and j.day = w.day",
}
_EXTRA["sums"] = "select pid, count(*)::double as n, sum(x) as x, sum(stress) as y, sum(x * x) as xx, sum(x * stress) as xy, sum(stress * stress) as yy from (select *, any_deviation::int::double as x from joined where stress is not null) group by pid"
_EXTRA["grid1"] = "select 0 as i, 0.0::double as ratio union all select i + 1, pow(10.0, -4 + 6 * i / 239.0::double) from (select unnest(range(240)) as i)"
for _k in (1, 2, 3):
    _EXTRA[f"fit{_k}"] = f"""select *, -0.5 * (rows * (ln(2 * pi() * rss / rows) + 1) + ld) as ll, -0.5 * (rows * (ln(2 * pi() * (c - b1 * b1 / a11) / rows) + 1) + ld) as ll0, rss / rows as residual, sqrt(rss / rows * a11 / det) as se from (
      select *, c - b1 * (a22 * b1 - a12 * b2) / det - b2 * estimate as rss from (select *, (a11 * b2 - a12 * b1) / det as estimate from (select *, a11 * a22 - a12 * a12 as det from (
        select i, ratio, count(*) as groups, sum(n) as rows, sum(n - w * n * n) as a11, sum(x - w * n * x) as a12, sum(xx - w * x * x) as a22, sum(y - w * n * y) as b1, sum(xy - w * x * y) as b2, sum(yy - w * y * y) as c, sum(ln(1 + n * ratio)) as ld
        from (select g.*, s.*, ratio / (1 + n * ratio) as w from sums s, grid{_k} g) group by i, ratio)) where det > 1e-12))"""
    _EXTRA[f"grid{_k + 1}"] = f"""select unnest(range(241)) as i, lo + (hi - lo) * unnest(range(241)) / 240.0 as ratio from (
      select (select ratio from grid{_k} where i = greatest(b - 1, 0)) as lo, (select ratio from grid{_k} where i = least(b + 1, 240)) as hi from (select arg_max(i, ll) as b from fit{_k}))"""


def _mixed_sql(rows: str) -> dict[str, str]:
    """Common table expressions m_*: the mixed model of rows (label, pid, x, y) for each label, m_fit3 being the last round."""
    out = {"m_sums": f"select label, pid, count(*)::double as n, sum(x) as x, sum(y) as y, sum(x * x) as xx, sum(x * y) as xy, sum(y * y) as yy from ({rows}) group by label, pid", "m_grid1": "select label, i, ratio from (select distinct label from m_sums), grid1"}
    for k in (1, 2, 3):
        fit = _EXTRA[f"fit{k}"].replace("select i, ratio, count", "select s.label, i, ratio, count").replace("from sums s, grid", "from m_sums s join m_grid").replace(f"grid{k} g)", f"grid{k} g on g.label = s.label)").replace("select g.*, s.*,", "select g.i, g.ratio, s.*,").replace("group by i, ratio", "group by s.label, i, ratio").replace("s.label, i", "label, i")
        out[f"m_fit{k}"] = fit
        out[f"m_grid{k + 1}"] = f"""select label, unnest(range(241)) as i, lo + (hi - lo) * unnest(range(241)) / 240.0 as ratio from (
          select f.label, max(g.ratio) filter (g.i = greatest(b - 1, 0)) as lo, max(g.ratio) filter (g.i = least(b + 1, 240)) as hi from (select label, arg_max(i, ll) as b from m_fit{k} group by label) f join m_grid{k} g on g.label = f.label group by f.label)"""
    return out


_FLAGS_LONG = " union all ".join(f"select '{c}' as label, pid, {c} as flag, stress as y from joined" for c in FLAGS)


def _p(t: str, df: str) -> str:
    area = lambda lo: f"((pi() / 2 - {lo}) * list_sum(list_transform(range(0, 1001), lambda i: (case when i = 0 or i = 1000 then 1 when i % 2 = 1 then 4 else 2 end) * pow(greatest(cos({lo} + (pi() / 2 - {lo}) * i / 1000), 0), {df} - 1))))"
    return f"case when {df} > 0 then {area(f'atan(abs({t}) / sqrt({df}))')} / {area('0.0')} end"


def _tests_sql(source: str) -> str:
    return f"""select *, {_p('t', 'df')} as p from (select *, case when se > 0 then diff / sqrt(se) end as t, case when se > 0 then se * se / (v1 * v1 / (n_yes * n_yes * (n_yes - 1)) + v0 * v0 / (n_no * n_no * (n_no - 1))) end as df,
      case when v1 + v0 > 0 then diff / sqrt((v1 + v0) / 2) end as cohen_d from (select *, case when n_yes >= 2 and n_no >= 2 then v1 / n_yes + v0 / n_no end as se, mean_yes - mean_no as diff from (
        select label, count(y) filter (flag) as n_yes, count(y) filter (not flag) as n_no, avg(y) filter (flag) as mean_yes, avg(y) filter (not flag) as mean_no, var_samp(y) filter (flag) as v1, var_samp(y) filter (not flag) as v0
        from ({source}) where y is not null group by label)))"""


def _spearman_sql(table: str, x: str, y: str, label: str = "") -> str:
    return f"""select {label} n, r, {_p('(r * sqrt((n - 2) / (1 - r * r)))', '(n - 2)')} as p from (select count(*) as n, corr(rx, ry) as r from (
      select rank() over (order by {x}) + (count(*) over (partition by {x}) - 1) / 2.0 as rx, rank() over (order by {y}) + (count(*) over (partition by {y}) - 1) / 2.0 as ry from {table} where {x} is not null and {y} is not null))"""


_BY_PERSON = """select pid, n, r from (select pid, count(*) as n, corr(rx, ry) as r from (
  select pid, rank() over (partition by pid order by n_dev) + (count(*) over (partition by pid, n_dev) - 1) / 2.0 as rx, rank() over (partition by pid order by stress) + (count(*) over (partition by pid, stress) - 1) / 2.0 as ry
  from joined where stress is not null) group by pid) where n >= 3 and r is not null and not isnan(r)"""


def _sql(names: list[str], q: str, extra: list[str]) -> str:
    return with_(names, q, {k: _EXTRA[k] for k in extra})


_J = ["stress", "flagged", "joined"]
_Q = lambda q: _sql(["daily"], q, _J)
_AL = ["stress", "pam", "slept", "outcomes", "aligned"]
_TAIL = lambda z: f"((((({z} * 1.061405429 - 1.453152027) * {z} + 1.421413741) * {z} - 0.284496736) * {z} + 0.254829592) * {z})"
_N2 = lambda z: f"({_TAIL(f'(1.0 / (1.0 + {z} / sqrt(2.0) * 0.3275911))')} * exp(-({z}) * ({z}) / 2))"
SQL = {
    "stress_daily": _sql(["ev"], "select pid, day, round(stress, 6) as stress from stress", ["stress"]),
    "pam_daily": _sql(["ev"], "select pid, day, round(valence, 6) as valence, round(arousal, 6) as arousal from pam", ["pam"]),
    "sleep_ema_daily": _sql(["ev"], "select pid, day, round(sleep_hours, 6) as sleep_hours, round(sleep_quality, 6) as sleep_quality from slept", ["slept"]),
    "response_timing": with_(["ev"], "select kind, count(*) as n, round(quantile_cont(h, 0.5), 6) as median, round(quantile_cont(h, 0.1), 6) as p10, round(quantile_cont(h, 0.9), 6) as p90, round(100 * avg((h < 12)::int), 6) as before_noon_pct from (select *, hour(ts) + minute(ts) / 60.0::double as h from ev where kind in ('error', 'view', 'signup')) group by kind"),
    "outcome_alignment": _sql(["ev", "history"], "select pid, day, " + ", ".join(f"round({c}, 6) as {c}" for c in ALIGNED) + " from aligned", _AL),
    "ema_coverage": _sql(["ev", "history"], "select outcome, count(*) as days, count(distinct pid) as people from (" + " union all ".join(f"select '{c}' as outcome, pid, {c} as v from aligned" for c in ALIGNED) + ") where v is not null group by outcome", _AL),
    "pattern_flags": _Q("select pid, day, " + ", ".join(FLAGS) + " from joined"),
    "confident_patterns": _sql(["daily", "rules"], "select pid, day, round(any_least, 6) as any_least, coalesce(array_to_string(hit, '|'), '') as confident, coalesce(len(hit), 0) > 0 as any_confident from conf", [*_J, "least", "conf"]),
    "binary_outcome": _Q(f"select label, n_yes, n_no, round(mean_yes, 6) as mean_yes, round(mean_no, 6) as mean_no, round(diff, 6) as diff from ({_tests_sql(_FLAGS_LONG)})"),
    "cohen_d": _Q(f"select label, round(cohen_d, 6) as cohen_d from ({_tests_sql(_FLAGS_LONG)})"),
    "welch_test": _Q(f"select label, round(t, 6) as t, round(df, 6) as df, round(p, 6) as p from ({_tests_sql(_FLAGS_LONG)})"),
    "spearman_pooled": _Q(f"select n, round(r, 6) as r, round(p, 6) as p from ({_spearman_sql('joined', 'risk_index', 'stress')})"),
    "spearman_by_person": _Q(f"select count(*) as people, round(median(r), 6) as median, round(avg(r), 6) as mean, round(100 * avg((round(r, 9) > 0)::int), 6) as positive_pct from ({_BY_PERSON})"),
    "exemplar": _Q(f"select pid, n, round(r, 6) as r from ({_BY_PERSON}) order by round(r, 6) desc, pid limit 1"),
    "cluster_bootstrap": _Q("""
select count(*) as reps, round(quantile_cont(diff, 0.025), 6) as low, round(quantile_cont(diff, 0.975), 6) as high from (select sum(s1) / sum(n1) - sum(s0) / sum(n0) as diff from (
  select rep, ('0x' || left(md5('boot|' || rep || '|' || draw), 8))::bigint % p as i from (select unnest(range(1000)) as rep), (select count(distinct pid) as p from joined where stress is not null), lateral (select unnest(range(p)) as draw)) d
  join (select row_number() over (order by pid) - 1 as i, count(*) filter (any_pattern) as n1, coalesce(sum(stress) filter (any_pattern), 0) as s1, count(*) filter (not any_pattern) as n0, coalesce(sum(stress) filter (not any_pattern), 0) as s0 from joined where stress is not null group by pid) g on g.i = d.i
  group by rep having sum(n1) >= 5 and sum(n0) >= 5)"""),
    "within_person": _Q("""
select n, k as n_positive, round(med, 6) as median_diff, round(mean, 6) as mean_diff, round(100.0 * k / n, 6)::double as percent_positive,
  round(least(1.0, 2 * list_sum(list_transform(range(greatest(k, n - k), n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0))))), 6) as p
from (select count(*) as n, count(*) filter (diff > 0) as k, median(diff) as med, avg(diff) as mean from (
  select avg(stress) filter (any_deviation) - avg(stress) filter (not any_deviation) as diff from joined where stress is not null group by pid having count(*) filter (any_deviation) >= 2 and count(*) filter (not any_deviation) >= 2))"""),
    "ablation": _sql(["daily", "rules"], "select label, n, round(effect, 6) as effect, round(p, 6) as p from (select label, n_yes as n, diff as effect, p from (" + _tests_sql("select 'any_deviation' as label, any_deviation as flag, stress as y from conf union all select 'any_pattern', any_pattern, stress from conf union all select 'any_confident', coalesce(len(hit), 0) > 0, stress from conf") + ") " + "".join(f" union all select '{x}', n, r, p from ({_spearman_sql('conf', x, 'stress')})" for x in ("n_dev", "n_pat", "risk_index")) + ")", [*_J, "least", "conf"]),
    "marker_coverage": with_(["long"], "select marker, round(avg(coverage), 6) as mean_coverage, round(100 * avg((coverage > 0)::int), 6) as any_pct, round(100 * avg((coverage >= 0.45)::int), 6) as medium_pct, round(100 * avg((coverage >= 0.75)::int), 6) as high_pct from long group by marker"),
    "mixed_model": _sql(["daily"], f"""
select groups, rows::bigint as rows, round(estimate, 6) as estimate, round(se, 6) as se, round(residual, 4) as residual, round(ratio / (1 + ratio), 4) as icc, round(ll, 6) as loglik, round(lrt, 6) as lrt,
  round({_N2('abs(estimate / se)')}, 5) as p, round({_N2('sqrt(lrt)')}, 5) as lrt_p
from (select *, greatest(2 * (ll - (select max(ll0) from fit1)), 0) as lrt from fit3 order by ll desc limit 1)""", [*_J, "sums", "grid1", "fit1", "grid2", "fit2", "grid3", "fit3"]),
    "construct_outcomes": _sql(["daily", "history"], "select state, outcome, count(*) filter (flag) as n_yes, count(*) filter (not flag) as n_no, round(avg(y) filter (flag) - avg(y) filter (not flag), 6) as diff from (" + " union all ".join(f"select '{s}' as state, '{c}' as outcome, f.{s} as flag, a.{c} as y from flagged f join aligned a on a.pid = f.pid and a.day = f.day" for s in FLAGS for c in ALIGNED) + ") where y is not null group by all", ["stress", "pam", "slept", "outcomes", "aligned", "flagged"]),
    "risk_above_median": _Q("select label, n_yes, n_no, round(diff, 6) as diff, round(p, 6) as p from (" + _tests_sql("select 'above' as label, risk_index > (select median(risk_index) from joined where stress is not null) as flag, stress as y from joined") + ")"),
    "risk_histogram": _Q("select *, round(n / sum(n) over (partition by band), 6)::double as density from (select case when stress >= 2 then 'high' when stress <= 1 then 'low' else 'mid' end as band, floor(risk_index)::bigint as bin, count(*) as n from joined where stress is not null group by all)"),
    "cohort_summary": _Q("select count(*) as warm_days, count(distinct pid) as people, count(stress) as labelled_days, count(*) filter (any_pattern) as pattern_days from joined"),
    "bucket_counts": _Q("select bucket, count(*) as fires, count(stress) as labelled, count(distinct pid) as people from (" + " union all ".join(f"select '{c}' as bucket, pid, stress, {c} as flag from joined" for c in FLAGS) + ") where flag group by bucket"),
}
SQL["predictor_comparison"] = _Q("select label, test, round(effect, 6) as effect, round(p, 6) as p from (select label, 'welch' as test, diff as effect, p from (" + _tests_sql(_FLAGS_LONG) + ")" + "".join(f" union all select '{x}', 'spearman', r, p from ({_spearman_sql('joined', x, 'stress')})" for x in ("n_dev", "n_pat", "risk_index", "n_markers_present")) + ")")

_PAIRED = " union all ".join(f"select '{'/'.join((state, role, c, when))}' as label, f.pid, coalesce(f.{state.replace('-', '_')}, false) as flag, a.{c}_{when}::double as y, {'-' if c in ('valence', 'sleep_hours') else ''}a.{c}_{when}::double as raw from flagged f join aligned a on a.pid = f.pid and a.day = f.day" for state, role, c, when in PAIRINGS)
_PAIR_CTE = {k: _EXTRA[k] for k in (*_AL, "flagged", "grid1")} | {"paired": f"select *, flag::int::double as x from ({_PAIRED}) where y is not null"} | _mixed_sql("select * from paired")
SQL["construct_table"] = with_(["daily", "history"], f"""
select t.label, t.n_yes, t.n_no, yes_people, people, coalesce(ranked_people, 0) as ranked_people, round(t.mean_yes, 6) as mean_yes, round(t.mean_no, 6) as mean_no, round(raw_mean_yes, 6) as raw_mean_yes, round(raw_mean_no, 6) as raw_mean_no, round(t.p, 6) as welch_p, round(cohen_d, 6) as cohen_d, round(median_r, 6) + 0.0 as median_r, round(positive_pct, 6) as positive_pct,
  round(m.estimate, 4) as mixed_estimate, round(m.se, 4) as mixed_se, round({_N2('abs(m.estimate / m.se)')}, 4) as mixed_p, round(m.ratio / (1 + m.ratio), 4) as mixed_icc, round({_N2('sqrt(greatest(2 * (m.ll - m0.ll0), 0))')}, 4) as mixed_lrt_p
from ({_tests_sql('select label, flag, y from paired')}) t
join (select label, avg(raw) filter (flag) as raw_mean_yes, avg(raw) filter (not flag) as raw_mean_no, count(distinct pid) filter (flag) as yes_people, count(distinct pid) as people from paired group by label) r on r.label = t.label
left join (select * from m_fit3 qualify row_number() over (partition by label order by ll desc) = 1) m on m.label = t.label left join (select label, max(ll0) as ll0 from m_fit1 group by label) m0 on m0.label = t.label
left join (select label, count(*) as ranked_people, median(r) as median_r, 100 * avg((round(r, 9) > 0)::int) as positive_pct from (select label, pid, count(*) as n, corr(rx, ry) as r, stddev_pop(rx) * stddev_pop(ry) as v from (
  select label, pid, rank() over (partition by label, pid order by x) + (count(*) over (partition by label, pid, x) - 1) / 2.0 as rx, rank() over (partition by label, pid order by y) + (count(*) over (partition by label, pid, y) - 1) / 2.0 as ry from paired) group by label, pid) where n >= 3 and v > 1e-12 group by label) k on k.label = t.label""", _PAIR_CTE)
