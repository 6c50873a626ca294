"""Self-report outcomes by day, and their alignment with pipeline days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayline.functions.columns import grid_cell

#: Highest valid code, and the severity of a code: the recode is a parameter of the operator.
STRESS_LEVELS = 5


def stress_daily(answers: DataFrame, severity=lambda level: F.greatest(F.lit(0), 4 - level)) -> DataFrame:
    """(pid, day, stress): mean severity of a day's valid levels in (pid, day, level); others are ignored."""
    level = F.col("level").try_cast("int")
    return answers.withColumn("level", level).where(F.col("level").between(1, STRESS_LEVELS)).groupBy("pid", "day").agg(F.avg(severity(F.col("level")).cast("double")).alias("stress"))


def pam_daily(answers: DataFrame) -> DataFrame:
    """(pid, day, valence, arousal): mean column and row of the pictures 1 to 16 picked."""
    idx = F.col("picture_idx").try_cast("int")
    column, row = grid_cell(F.col("picture_idx"))
    return answers.withColumn("picture_idx", idx).where(F.col("picture_idx").between(1, 16)).groupBy("pid", "day").agg(F.avg(column).alias("valence"), F.avg(row).alias("arousal"))


def sleep_answers_daily(answers: DataFrame) -> DataFrame:
    """(pid, day, sleep_hours, sleep_quality): each mean over its own valid codes (1-19 and 1-4); null without any."""
    hour, rate = F.col("hour").try_cast("int"), F.col("rate").try_cast("int")
    hours = F.when(hour == 1, 2.5).when(hour.between(2, 19), hour + 1.5)
    out = answers.groupBy("pid", "day").agg(F.avg(hours).alias("sleep_hours"), F.avg(F.when(rate.between(1, 4), rate)).alias("sleep_quality"))
    return out.where("sleep_hours is not null or sleep_quality is not null")


def response_timing(hours: Column) -> list[Column]:
    """Aggregates over the hours at which people answered."""
    return [F.count(hours).alias("n"), F.percentile(hours, F.lit(0.5)).alias("median"), F.percentile(hours, F.lit(0.1)).alias("p10"), F.percentile(hours, F.lit(0.9)).alias("p90"), (100 * F.avg((hours < 12).cast("int"))).alias("before_noon_pct")]


def align(daily: DataFrame, outcomes: DataFrame, names: list[str], flip: tuple[str, ...] = ()) -> DataFrame:
    """`daily` with each outcome of the same and the next day; outcomes in `flip` are negated, so that larger is worse."""
    o = outcomes.select("pid", "day", *[(-F.col(c) if c in flip else F.col(c)).alias(c) for c in names])
    same = o.select("pid", "day", *[F.col(c).alias(f"{c}_same") for c in names])
    following = o.select("pid", F.date_sub("day", 1).alias("day"), *[F.col(c).alias(f"{c}_next") for c in names])
    return daily.join(same, ["pid", "day"], "left").join(following, ["pid", "day"], "left")
