"""Queries of the baseline, deviation and pattern operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayline.functions import registry
from dayline.operators import baseline as B
from dayline.plans.fixtures import deviations_sql, framed, marker_days, marker_long, quality_sql, stats_sql, with_

R, N, WARM = 4, 21, 10
#: Keeps quantiles of short decimals off the ties of rounding, which engines break differently.
TIE = 1.7e-11
r6 = lambda *cs: [F.round(c, 6).alias(c) for c in cs]


def q_marker_days_wide(spark: SparkSession, d: str) -> DataFrame:
    return marker_days(spark, d).select("pid", "day", *r6(*registry.NAMES))


def q_marker_days_long(spark: SparkSession, d: str) -> DataFrame:
    return marker_long(spark, d).select("pid", "day", "marker", *r6("value", "coverage"))


def q_markers_present(spark: SparkSession, d: str) -> DataFrame:
    return marker_long(spark, d).groupBy("pid", "day").agg(F.count_if(F.col("coverage") >= 0.5).alias("n_markers_present"))


def q_baseline_stats(spark: SparkSession, d: str) -> DataFrame:
    s = B.baseline_stats(marker_long(spark, d), -(N - 1), 0)
    return s.select("pid", "day", "marker", F.col("n").cast("long").alias("n"), *[F.round(F.col(c) + TIE, 6).alias(c) for c in ("mean", "std", "median", "p20", "p80", "low", "high")])


def q_robust_std(spark: SparkSession, d: str) -> DataFrame:
    s = B.baseline_stats(marker_long(spark, d), -(R + N - 1), -R).where("mean is not null")
    return s.select("pid", "day", "marker", *[F.round(c, 8).alias(c) for c in ("pop_std", "mad_std", "std")])


def q_coverage_quality(spark: SparkSession, d: str) -> DataFrame:
    return B.coverage_quality(marker_long(spark, d), 7).select("pid", "day", "marker", "quality")


def q_warmup(spark: SparkSession, d: str) -> DataFrame:
    days = marker_long(spark, d).select("pid", "day").distinct()
    return B.warmth(days, 3, R).withColumnRenamed("warm", "warm_service").join(B.warmth(days, WARM).select("pid", "day", "warm"), ["pid", "day"])


def q_deviations(spark: SparkSession, d: str) -> DataFrame:
    return B.deviations(marker_long(spark, d), R, N).select("pid", "day", "marker", "magnitude", "trajectory", "direction", "coverage", *r6("recent_mean", "baseline_mean", "baseline_std"), F.col("recent_days").cast("long").alias("recent_days"))


def q_deviation_magnitude(spark: SparkSession, d: str) -> DataFrame:
    return B.deviations(marker_long(spark, d), R, N, "within-typical").groupBy("marker", "magnitude").agg(F.count(F.lit(1)).alias("n"))


def q_deviation_trajectory(spark: SparkSession, d: str) -> DataFrame:
    return B.deviations(marker_long(spark, d), R, N, "within-typical").groupBy("trajectory").agg(F.count(F.lit(1)).alias("n"))


def q_coherent_patterns(spark: SparkSession, d: str) -> DataFrame:
    p = B.coherent_patterns(B.deviations(marker_long(spark, d), R, N))
    return p.select("pid", "day", "pattern", F.array_join("implicated", "|").alias("implicated"))


def q_patterns_tight(spark: SparkSession, d: str) -> DataFrame:
    p = B.coherent_patterns(B.deviations(marker_long(spark, d), R, N), 2)
    return p.where("pattern = 'circadian-instability'").select("pid", "day", F.array_join("implicated", "|").alias("implicated"))


def q_pattern_frequency(spark: SparkSession, d: str) -> DataFrame:
    daily = B.daily_pipeline(marker_long(spark, d), WARM, R, N)
    return daily.where("n_pat > 0").select(F.explode(F.split("pattern_names", r"\|")).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def q_risk_index(spark: SparkSession, d: str) -> DataFrame:
    return B.daily_pipeline(marker_long(spark, d), WARM, R, N).select("pid", "day", "risk_index")


def q_daily_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return B.daily_pipeline(marker_long(spark, d), WARM, R, N).drop("history")


QUERIES = {k[2:]: v for k, v in globals().items() if k.startswith("q_")}

_R6 = lambda *cs: ", ".join(f"round({c}, 6) as {c}" for c in cs)
_ALL = {"stats": stats_sql(-(R + N - 1), -R), "devs": deviations_sql(R, N, 0)}
SQL = {
    "marker_days_wide": with_(["wide"], f"select pid, day, {_R6(*registry.NAMES)} from wide"),
    "marker_days_long": with_(["long"], f"select pid, day, marker, {_R6('value', 'coverage')} from long"),
    "markers_present": with_(["long"], "select pid, day, count(*) filter (coverage >= 0.5) as n_markers_present from long group by all"),
    "baseline_stats": with_(["usable", "spec"], f"select pid, day, marker, n, round(mean + {TIE}, 6) as mean, round(case when n is not null then std end + {TIE}, 6) as std, " + ", ".join(f"round({c} + {TIE}, 6) as {c}" for c in ("median", "p20", "p80", "low", "high")) + " from s", {"s": stats_sql(-(N - 1), 0)}),
    "robust_std": with_(["stats"], "select pid, day, marker, round(pop_std, 8) as pop_std, round(mad_std, 8) as mad_std, round(std, 8) as std from stats where mean is not null"),
    "coverage_quality": with_(["long"], f"select pid, day, marker, {quality_sql('a')} as quality from (select *, avg(coverage) over {framed(-6, 0)} as a from long)"),
    "warmup": with_(["history"], "select pid, day, history, history >= 7 as warm_service, history >= 10 as warm from history"),
    "deviations": with_(["devs"], f"select pid, day, marker, magnitude, trajectory, direction, coverage, {_R6('recent_mean', 'baseline_mean', 'baseline_std')}, recent_days from devs"),
    "deviation_magnitude": with_(["usable", "spec"], "select marker, magnitude, count(*) as n from devs group by all", _ALL),
    "deviation_trajectory": with_(["usable", "spec"], "select trajectory, count(*) as n from devs group by all", _ALL),
    "coherent_patterns": with_(["pats"], "select pid, day, pattern, array_to_string(implicated, '|') as implicated from pats"),
    "patterns_tight": with_(["pats"], "select pid, day, array_to_string(implicated, '|') as implicated from pats where pattern = 'circadian-instability' and len(implicated) >= 2"),
    "pattern_frequency": with_(["daily"], "select unnest(string_split(pattern_names, '|')) as pattern, count(*) as n from daily where n_pat > 0 group by 1"),
    "risk_index": with_(["daily"], "select pid, day, risk_index from daily"),
    "daily_pipeline": with_(["daily"], "select pid, day, risk_index, n_dev, n_pat, warm, n_markers_present, pattern_names, dev_markers from daily"),
}
