"""Personal baselines and deviations over a long table (pid, day, day_num, marker, value, coverage)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayline.functions import columns as C
from dayline.functions import registry

#: Coverage from which a day's value counts.
USABLE = 0.5


def to_long(wide: DataFrame) -> DataFrame:
    """One row for each marker of a wide day (pid, day, markers, coverage map).

    Coverage is that of the map, else 1; it is 0 where the value is missing. Of repeated days one row counts.
    """
    long = wide.dropDuplicates(["pid", "day"]).unpivot(["pid", "day", "coverage"], registry.NAMES, "marker", "value")
    given = F.coalesce(F.try_element_at("coverage", F.col("marker")), F.lit(1.0))
    long = long.withColumn("coverage", F.when(F.col("value").isNull(), 0.0).otherwise(given))
    return long.withColumn("day_num", F.datediff("day", F.lit("1970-01-01").cast("date")))


def _frame(first: int, last: int):
    return Window.partitionBy("pid", "marker").orderBy("day_num").rangeBetween(first, last)


def _usable() -> Column:
    return F.when((F.col("coverage") >= USABLE) & F.col("value").isNotNull(), F.col("value"))


def quality(average: Column, rows: Column) -> Column:
    """Class of an average coverage; `none` without rows."""
    return F.when(rows == 0, "none").when(average >= 0.75, "high").when(average >= 0.45, "medium").when(average > 0, "low").otherwise("none")


def baseline_stats(long: DataFrame, first: int, last: int) -> DataFrame:
    """Statistics of the usable values in days [first, last] relative to each row; null below three values."""
    df = long.join(F.broadcast(registry.marker_table(long.sparkSession).select("marker", "least_std")), "marker", "left")
    w, v, a = _frame(first, last), _usable(), F.col("_a")
    df = df.select("*", F.sort_array(F.collect_list(v).over(w)).alias("_a"), F.avg(v).over(w).alias("_mean"), F.stddev_pop(v).over(w).alias("_std"))
    df = df.withColumn("_median", C.quantile(a, 0.5))
    deviation = F.sort_array(F.transform(a, lambda x: F.abs(x - F.col("_median"))))
    df = df.withColumn("_mad", deviation)
    stats = {
        "n": F.size(a),
        "mean": F.col("_mean"),
        "pop_std": F.col("_std"),
        "mad_std": C.quantile(F.col("_mad"), 0.5) * 1.4826,
        "median": F.col("_median"),
        "p20": C.quantile(a, 0.2),
        "p80": C.quantile(a, 0.8),
        "low": F.get(a, F.lit(0)),
        "high": F.get(a, F.size(a) - 1),
    }
    enough = F.size("_a") >= 3
    df = df.select("*", *[F.when(enough, v).alias(k) for k, v in stats.items()])
    df = df.withColumn("std", F.when(enough, F.greatest("pop_std", "mad_std", F.coalesce("least_std", F.lit(1e-3)))))
    return df.drop("_a", "_mean", "_std", "_median", "_mad", "least_std")


def coverage_quality(long: DataFrame, days: int = 7) -> DataFrame:
    """Coverage class of the last `days` days at each row."""
    w = _frame(-(days - 1), 0)
    return long.withColumn("coverage_mean", F.avg("coverage").over(w)).withColumn("quality", quality(F.col("coverage_mean"), F.count(F.lit(1)).over(w)))


def warmth(days: DataFrame, warmup: int = 10, recent: int = 0) -> DataFrame:
    """Days of history up to each (pid, day), and whether they suffice; with `recent` the service's stricter need."""
    need = max(warmup, recent + 3) if recent else warmup
    n = F.count(F.lit(1)).over(Window.partitionBy("pid").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return days.withColumn("history", n).withColumn("warm", F.col("history") >= need)


def magnitude(z: Column) -> Column:
    a = F.abs(z)
    return F.when(a < 1.0, "within-typical").when(a < 1.8, "mild").when(a < 2.8, "moderate").otherwise("pronounced")


def magnitude_rank(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, m in enumerate(registry.MAGNITUDES):
        out = F.when(name == m, i).otherwise(out)
    return out


def trajectory(zs: Column) -> Column:
    """Shape of an array of z-scores, oldest first."""
    n = F.size(zs)
    raised = F.size(F.filter(zs, lambda z: F.abs(z) >= 1.0))
    one_sign = F.forall(zs, lambda z: z > 0) | F.forall(zs, lambda z: z <= 0)
    growing = F.forall(F.arrays_zip(F.slice(zs, 1, F.greatest(n - 1, F.lit(0))).alias("x"), F.slice(zs, 2, F.greatest(n - 1, F.lit(0))).alias("y")), lambda p: F.abs(p["x"]) <= F.abs(p["y"]) + 0.2)
    newest = F.abs(F.get(zs, n - 1)) >= 1.0
    days = n.cast("string")
    return (
        F.when(n == 0, "no-data")
        .when(raised == 0, "within-typical")
        .when(n == 1, "acute-1d")
        .when((raised == n) & one_sign, F.concat(F.lit("sustained-"), days, F.lit("d")))
        .when((n >= 3) & one_sign & growing & newest, F.concat(F.lit("drift-emerging-"), days, F.lit("d")))
        .when(newest & (raised == 1), "acute-1d")
        .otherwise(F.concat(F.lit("intermittent-"), raised.cast("string"), F.lit("d-of-"), days))
    )


def _scored(long: DataFrame, recent: int, baseline: int, least: str) -> DataFrame:
    """Every row of `long` with its recent days scored by the baseline before them, and whether they deviate (`hit`)."""
    df = baseline_stats(long, -(recent + baseline - 1), -recent)
    w = _frame(-(recent - 1), 0)
    df = df.withColumn("recent", F.collect_list(_usable()).over(w)).withColumn("coverage_class", quality(F.avg("coverage").over(w), F.count(F.lit(1)).over(w)))
    df = df.withColumn("recent_mean", C.mean(F.col("recent"))).withColumn("z", F.round((F.col("recent_mean") - F.col("mean")) / F.col("std"), 9))
    df = df.withColumn("magnitude", magnitude(F.col("z"))).withColumn("direction", F.when(F.col("z") > 0, "up").otherwise("down"))
    return df.withColumn("hit", F.coalesce(F.col("mean").isNotNull() & (F.size("recent") >= max(2, recent // 2)) & (magnitude_rank(F.col("magnitude")) >= registry.MAGNITUDES.index(least)), F.lit(False)))


def _course() -> Column:
    return trajectory(F.transform("recent", lambda v: F.round((v - F.col("mean")) / F.col("std"), 9)))


def deviations(long: DataFrame, recent: int = 4, baseline: int = 28, least: str = "mild") -> DataFrame:
    """Markers whose recent mean leaves the preceding baseline, one row for each (pid, day, marker)."""
    df = _scored(long, recent, baseline, least).where("hit")
    return df.select(
        "pid", "day", "marker", "magnitude", _course().alias("trajectory"), "direction", F.col("coverage_class").alias("coverage"),
        "recent_mean", F.col("mean").alias("baseline_mean"), F.col("std").alias("baseline_std"), F.size("recent").alias("recent_days"), "z",
    )


def scored_deviations(long: DataFrame, recent: int = 4, baseline: int = 28, least: str = "mild", days: int = 7) -> DataFrame:
    """Every row of `long` with what `deviations` says of it where it deviates (`hit`) and its `quality` over the last `days` days, in one sort."""
    df = coverage_quality(_scored(long, recent, baseline, least), days)
    course = F.when(F.col("hit"), _course())
    return df.select("pid", "day", "marker", "hit", "magnitude", course.alias("trajectory"), "direction", "coverage_class", "recent_mean", F.col("mean").alias("baseline_mean"), "quality")


def coherent_patterns(devs: DataFrame, least_circadian: int = 1) -> DataFrame:
    """(pid, day, pattern, implicated array): every required marker deviates in its direction; optional ones are added."""
    rules = registry.rule_table(devs.sparkSession)
    needs = rules.groupBy("pattern").agg(F.count_if("required").alias("needed"))
    hit = devs.join(F.broadcast(rules.join(needs, "pattern")), ["marker", "direction"])
    hit = hit.where((F.col("magnitude") != "within-typical") | ~F.col("required"))
    found = hit.groupBy("pid", "day", "pattern", "pattern_position", "needed").agg(F.count_if("required").alias("met"), F.sort_array(F.collect_list(F.struct("position", "marker"))).alias("m"))
    found = found.where("met = needed").select("pid", "day", "pattern", "pattern_position", F.col("m.marker").alias("implicated"))
    return found.where((F.col("pattern") != "circadian-instability") | (F.size("implicated") >= least_circadian))


def fires(devs: Column, pattern: str, least_circadian: int = 1) -> Column:
    """Whether an array of a day's deviations (marker, direction, magnitude) holds all that a pattern requires."""
    rules = [r for r in registry.RULES if r[0] == pattern]

    def among(rule: tuple, typical: bool) -> Column:
        return F.exists(devs, lambda d: (d["marker"] == rule[1]) & (d["direction"] == rule[2]) & (F.lit(typical) | (d["magnitude"] != "within-typical")))

    out = F.lit(True)
    for r in rules:
        if r[3]:
            out = out & among(r, False)
    if pattern == "circadian-instability" and least_circadian > 1:
        out = out & (sum((among(r, True).cast("int") for r in rules), F.lit(0)) >= least_circadian)
    return out


def implicated(devs: Column, pattern: str) -> Column:
    """The markers of a pattern that an array of a day's deviations holds, in the order of the rules."""
    met = lambda r: F.exists(devs, lambda d: (d["marker"] == r[1]) & (d["direction"] == r[2]) & (F.lit(not r[3]) | (d["magnitude"] != "within-typical")))
    return F.filter(F.array(*[F.when(met(r), F.lit(r[1])) for r in registry.RULES if r[0] == pattern]), lambda x: x.isNotNull())


def daily_pipeline(long: DataFrame, warmup: int = 10, recent: int = 4, baseline: int = 21, least: str = "mild", least_circadian: int = 1) -> DataFrame:
    """One row for each (pid, day): risk index, deviations and patterns; days before the warm-up have none.

    The scored rows are grouped by day once: a day's deviations (ten markers at most) are an array, and the patterns are
    read off it, so that nothing is joined and the frames are computed once.
    """
    place = F.create_map(*[F.lit(x) for i, m in enumerate(registry.NAMES) for x in (m, i)])
    dev = F.struct(F.coalesce(F.try_element_at(place, F.col("marker")), F.lit(-1)).alias("position"), "marker", "direction", "magnitude", magnitude_rank(F.col("magnitude")).alias("rank"))
    known = F.col("hit") & F.col("marker").isin(registry.NAMES)
    days = _scored(long, recent, baseline, least).groupBy("pid", "day").agg(F.count_if(F.col("coverage") >= USABLE).alias("n_markers_present"), F.sort_array(F.collect_list(F.when(known, dev))).alias("m"))
    fired = F.filter(F.array(*[F.when(fires(F.col("m"), p, least_circadian), F.lit(p)) for p in registry.PATTERNS]), lambda x: x.isNotNull())
    weight = F.aggregate("m", F.lit(0), lambda a, d: a + d["rank"])
    out = warmth(days.withColumn("q", fired), warmup)
    warm, zero = F.col("warm"), F.lit(0)
    return out.select(
        "pid", "day", F.when(warm, weight + 2 * F.size("q")).otherwise(zero).cast("double").alias("risk_index"), F.when(warm, F.size("m")).otherwise(zero).cast("long").alias("n_dev"), F.when(warm, F.size("q")).otherwise(zero).cast("long").alias("n_pat"), "warm",
        "n_markers_present", F.when(warm, F.array_join("q", "|")).otherwise("").alias("pattern_names"), F.when(warm, F.array_join("m.marker", "|")).otherwise("").alias("dev_markers"), "history",
    )
