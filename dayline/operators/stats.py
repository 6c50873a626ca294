"""Tests and models from sufficient statistics: one pass over the rows, the rest on small tables."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayline.functions.columns import normal_tail
from dayline.functions.staging import running_total, staged

STEPS = 1000


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t by Simpson's rule on the angle whose tangent is t / sqrt(df)."""
    half = F.lit(math.pi / 2)
    start = F.atan(F.abs(t) / F.sqrt(df))

    def area(lo: Column) -> Column:
        weight = lambda i: F.when((i == 0) | (i == STEPS), 1).when(i % 2 == 1, 4).otherwise(2)
        inner = F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda a, i: a + weight(i) * F.pow(F.greatest(F.cos(lo + (half - lo) * i / STEPS), F.lit(0.0)), df - 1))
        return inner * (half - lo)

    return F.when(df > 0, area(start) / area(F.lit(0.0)))


def binary_outcomes(df: DataFrame, flags: dict[str, Column], y: str) -> DataFrame:
    """One row for each labelled flag: sizes, means, difference, Cohen's d, Welch's t, df and p of y by flag."""
    long = df.where(F.col(y).isNotNull()).select(F.col(y).alias("y"), F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.coalesce(c, F.lit(False)).alias("flag")) for k, c in flags.items()])).alias("f")).select("y", "f.*")
    return two_samples(long)


def two_samples(long: DataFrame) -> DataFrame:
    """The tests of binary_outcomes for rows (label, flag, y) without nulls."""
    yes, no = F.when(F.col("flag"), F.col("y")), F.when(~F.col("flag"), F.col("y"))
    s = long.groupBy("label").agg(F.count(yes).alias("n_yes"), F.count(no).alias("n_no"), F.avg(yes).alias("mean_yes"), F.avg(no).alias("mean_no"), F.var_samp(yes).alias("v1"), F.var_samp(no).alias("v0"))
    n1, n0, v1, v0 = (F.col(c) for c in ("n_yes", "n_no", "v1", "v0"))
    both = (n1 >= 2) & (n0 >= 2)
    se = v1 / n1 + v0 / n0
    s = s.withColumn("diff", F.col("mean_yes") - F.col("mean_no"))
    s = s.withColumn("cohen_d", F.when(both & (v1 + v0 > 0), F.col("diff") / F.sqrt((v1 + v0) / 2)))
    s = s.withColumn("t", F.when(both & (se > 0), F.col("diff") / F.sqrt(se))).withColumn("df", F.when(both & (se > 0), se * se / (v1 * v1 / (n1 * n1 * (n1 - 1)) + v0 * v0 / (n0 * n0 * (n0 - 1)))))
    return s.withColumn("p", t_tail(F.col("t"), F.col("df"))).drop("v1", "v0")


def mid_ranks(df: DataFrame, value: str, out: str, times: str | None = None) -> DataFrame:
    """`df` with the average rank of `value`: the histogram of distinct values is ranked, by ranges where it is large, not the rows.

    `times` names a column that says how often a row counts.
    """
    h = running_total(df.groupBy(value).agg((F.sum(times) if times else F.count(F.lit(1))).alias("_c")), value, "_c", "_before")
    return df.join(h.select(value, (F.col("_before") + (F.col("_c") + 1) / 2).alias(out)), value)


def spearman(df: DataFrame, x: str, y: str, least: int = 10) -> DataFrame:
    """(n, r, p) of two columns over rows where neither is null; null r below `least` rows."""
    d = staged(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("_n")), "rank-pairs")
    d = mid_ranks(mid_ranks(d, x, "_rx", "_n"), y, "_ry", "_n")
    w, mean = F.col("_n"), lambda c: F.sum(F.col("_n") * (c))
    s = d.agg(F.coalesce(F.sum(w), F.lit(0)).alias("n"), mean(F.col("_rx")).alias("mx"), mean(F.col("_ry")).alias("my"), mean(F.col("_rx") * F.col("_ry")).alias("xy"), mean(F.col("_rx") * F.col("_rx")).alias("xx"), mean(F.col("_ry") * F.col("_ry")).alias("yy"))
    n, of = F.col("n"), lambda a, b, ab: F.col(ab) / F.col("n") - F.col(a) * F.col(b) / (F.col("n") * F.col("n"))
    s = s.select("n", of("mx", "my", "xy").alias("c"), F.sqrt(F.greatest(of("mx", "mx", "xx"), F.lit(0.0))).alias("sx"), F.sqrt(F.greatest(of("my", "my", "yy"), F.lit(0.0))).alias("sy"))
    varies = (n >= least) & (F.col("sx") * F.col("sy") > 1e-12)
    s = s.select("n", F.when(varies, F.col("c") / (F.col("sx") * F.col("sy"))).alias("r"))
    rest = F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-15))
    return s.withColumn("p", t_tail(F.col("r") * F.sqrt((F.col("n") - 2) / rest), F.col("n") - 2))


def spearman_by_group(df: DataFrame, group: str, x: str, y: str, least: int = 5) -> DataFrame:
    """(group, n, r) within each group of at least `least` rows with varying values."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    mid = lambda c: F.rank().over(Window.partitionBy(group).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(group, c)) - 1) / 2
    s = d.withColumn("_rx", mid(x)).withColumn("_ry", mid(y)).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("_rx", "_ry").alias("c"), F.stddev_pop("_rx").alias("sx"), F.stddev_pop("_ry").alias("sy"))
    varies = F.col("sx") * F.col("sy") > 1e-12
    return s.where((F.col("n") >= least) & varies).select(group, "n", F.when(varies, F.col("c") / (F.col("sx") * F.col("sy"))).alias("r"))


def within_person(df: DataFrame, group: str, flag: str, y: str, least: int = 2) -> DataFrame:
    """Differences of means within groups with `least` rows on each side: median, mean, share above 0, exact sign test."""
    d = df.where(F.col(y).isNotNull()).groupBy(group).agg(F.avg(F.when(F.col(flag), F.col(y))).alias("a"), F.avg(F.when(~F.col(flag), F.col(y))).alias("b"), F.count_if(flag).alias("n1"), F.count_if(~F.col(flag)).alias("n0"))
    d = d.where((F.col("n1") >= least) & (F.col("n0") >= least)).withColumn("diff", F.col("a") - F.col("b"))
    s = d.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("diff") > 0).alias("n_positive"), F.percentile("diff", F.lit(0.5)).alias("median_diff"), F.avg("diff").alias("mean_diff"))
    return s.withColumn("percent_positive", F.when(F.col("n") > 0, 100 * F.col("n_positive") / F.col("n"))).withColumn("p", sign_test(F.col("n_positive"), F.col("n")))


def sign_test(k: Column, n: Column) -> Column:
    """Exact two-sided p of k of n signs, by logarithms, in a number of steps that grows with n.

    The first term of the tail is the fold of its binomial coefficient, each further one follows from the one before.
    """
    k, n = k.cast("int"), n.cast("int")
    far = F.greatest(k, n - k)
    first = F.aggregate(F.sequence(F.lit(0), n - far), -n * math.log(2), lambda a, i: a + F.when(i > 0, F.ln((far + i) / i)).otherwise(0.0))
    step = lambda a, j: F.struct((a["p"] + F.exp(a["term"])).alias("p"), F.when(j < n, a["term"] + F.ln((n - j) / (j + 1))).alias("term"))
    terms = F.aggregate(F.sequence(far, n), F.struct(F.lit(0.0).alias("p"), first.alias("term")), step, lambda a: a["p"])
    return F.when(n > 0, F.least(F.lit(1.0), 2 * terms))


def cluster_bootstrap(df: DataFrame, group: str, flag: str, y: str, reps: int = 1000, seed: str = "boot", least: int = 5, least_reps: int = 20, most: int = 200_000) -> DataFrame:
    """(reps, low, high): 95 % interval of the difference of means when whole groups are drawn with replacement.

    Each group is four numbers. Up to `most` counted groups travel to all tasks: draw d of replicate r takes the group
    whose index is a hash of (seed, r, d). More stay where they are: how often a replicate draws each group is drawn at
    once (`drawn_counts`). Either way the result is the same under any partitioning, and a task sends on only its sums
    of the replicates.
    """
    g = df.where(F.col(y).isNotNull()).groupBy(group).agg(F.count_if(flag).alias("n1"), F.sum(F.when(F.col(flag), F.col(y)).otherwise(0.0)).alias("s1"), F.count_if(~F.col(flag)).alias("n0"), F.sum(F.when(F.col(flag), 0.0).otherwise(F.col(y))).alias("s0"))
    g = staged(running_total(g.withColumn("one", F.lit(1).cast("long")), group, "one", "at").drop("one"), "bootstrap-groups")
    groups = g.count()
    s = _hashed_draws(g, groups, reps, seed) if groups <= most else _counted_draws(g, groups, reps, seed)
    s = s.groupBy("rep").agg(*[F.sum(c).alias(c) for c in _SUMS]).where((F.col("n1") >= least) & (F.col("n0") >= least))
    s = s.select((F.col("s1") / F.col("n1") - F.col("s0") / F.col("n0")).alias("diff"))
    out = s.agg(F.count(F.lit(1)).alias("reps"), F.percentile("diff", F.lit(0.025)).alias("low"), F.percentile("diff", F.lit(0.975)).alias("high"))
    return out.select("reps", *[F.when(F.col("reps") >= least_reps, F.col(c)).alias(c) for c in ("low", "high")])


_SUMS = ["n1", "s1", "n0", "s0"]


def _hashed_draws(g: DataFrame, groups: int, reps: int, seed: str) -> DataFrame:
    """(rep, sums of a drawn group) for every draw; the draws meet the groups where they are made."""
    draws = g.sparkSession.range(reps).withColumnRenamed("id", "rep").withColumn("size", F.lit(groups)).where("size > 0").withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size").cast("long") - 1)))
    key = F.md5(F.concat_ws("|", F.lit(seed), "rep", "draw").cast("binary"))
    draws = draws.select("rep", (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % F.col("size")).alias("at"))
    return draws.join(F.broadcast(g), "at")


def drawn_counts(groups: int, block: int, part: int, rep: int, seed: str) -> np.ndarray:
    """How often each group of one block is drawn when `groups` draws are made with replacement from all of them.

    The draws that fall into the left half of the blocks are binomial given those of both halves, and so on down to the
    block, within which they are multinomial. Each split has a generator of its own, named by its place in the tree, so
    that all blocks of a replicate see the same splits without meeting.
    """
    named = lambda *name: np.random.default_rng(int.from_bytes(hashlib.md5("|".join(map(str, (seed, rep, *name))).encode()).digest(), "big"))
    size = lambda lo, hi: min(hi * block, groups) - lo * block
    lo, hi, left = 0, -(-groups // block), groups
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first = int(named(lo, hi).binomial(left, size(lo, mid) / size(lo, hi)))
        lo, hi, left = (lo, mid, first) if part < mid else (mid, hi, left - first)
    n = size(part, part + 1)
    return named("block", part).multinomial(left, np.full(n, 1 / n))


def _counted_draws(g: DataFrame, groups: int, reps: int, seed: str, block: int = 65_536) -> DataFrame:
    """(rep, sums over a block's drawn groups): a row for each replicate and block of `block` groups."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        values = np.stack([t.column(c).to_numpy().astype(float) for c in _SUMS])
        part = int(t.column("at")[0].as_py()) // block
        sums = np.array([values @ drawn_counts(groups, block, part, rep, seed) for rep in range(reps)])
        return pa.table({"rep": pa.array(range(reps), pa.int64()), **{c: pa.array(sums[:, i]) for i, c in enumerate(_SUMS)}})

    return g.groupBy(F.floor(F.col("at") / block).alias("block")).applyInArrow(run, "rep long, n1 double, s1 double, n0 double, s0 double")


def mixed_model(df: DataFrame, group: str, x: str, y: str, grid: int = 241, rounds: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """Random-intercept model by maximum likelihood, one row for each value of `by`: estimate, se, p, variances, ICC and likelihood ratio.

    A group is six sums. For a ratio of variances the likelihood is a closed form of sums over groups, so each round
    crosses the group sums with a small grid of ratios and narrows it round the best of each model. Nothing goes through the driver.
    """
    keys = list(by) or ["_model"]
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*(by or [F.lit(0).alias("_model")]), F.col(group).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    sums = staged(d.groupBy(*keys, "g").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("y") * F.col("y")).alias("yy")), "group-sums")
    ratios = F.array(*[F.lit(v) for v in [0.0] + [10 ** (-4 + 6 * i / (grid - 2)) for i in range(grid - 1)]])
    first = fits = staged(_profile(sums.select("*", F.posexplode(ratios).alias("i", "ratio")), keys), "fits")
    at = lambda i: F.get(ratios, i)
    for _ in range(rounds - 1):
        spans = fits.groupBy(*keys).agg(F.max_by("i", "loglik").alias("b"), *([F.first("lo").alias("lo"), F.first("hi").alias("hi")] if "lo" in fits.columns else []))
        low, high = F.greatest(F.col("b") - 1, F.lit(0)), F.least(F.col("b") + 1, F.lit(grid - 1))
        spans = staged(spans.select(*keys, at(low).alias("lo"), at(high).alias("hi")), "spans")
        cells = spans.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn("ratio", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (grid - 1))
        fits = staged(_profile(sums.join(cells.select(*keys, "i", "ratio"), keys), keys).join(spans, keys), "fits")
        at = lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / (grid - 1)
    best = fits.groupBy(*keys).agg(F.max_by(F.struct("ratio", "groups", "rows", "estimate", "intercept", "se", "residual"), "loglik").alias("b"), F.max("loglik").alias("loglik")).select(*keys, "b.*", "loglik")
    out = best.join(first.groupBy(*keys).agg(F.max("loglik0").alias("loglik0")), keys).withColumn("lrt", F.greatest(2 * (F.col("loglik") - F.col("loglik0")), F.lit(0.0)))
    z = F.abs(F.col("estimate") / F.col("se"))
    return out.select(*by, "groups", "rows", "estimate", "se", (2 * normal_tail(z)).alias("p"), (F.col("estimate") - 1.959963984540054 * F.col("se")).alias("low"), (F.col("estimate") + 1.959963984540054 * F.col("se")).alias("high"), "residual", (F.col("residual") * F.col("ratio")).alias("between"), (F.col("ratio") / (1 + F.col("ratio"))).alias("icc"), "loglik", "lrt", (2 * normal_tail(F.sqrt("lrt"))).alias("lrt_p"))


def construct_table(df: DataFrame, person: str = "pid", least_days: int = 3) -> DataFrame:
    """Tests of labelled days (label, pid, flag, raw, y) for each label: sizes, means, Welch, Cohen's d, the mixed model and ranks within people.

    A person's rank correlation counts when they have `least_days` days on which both flag and y vary.
    """
    d = staged(df.where(F.col("y").isNotNull()).withColumn("x", F.coalesce("flag", F.lit(False)).cast("int")), "constructs")
    t = two_samples(d.select("label", F.col("x").cast("boolean").alias("flag"), "y")).select("label", "n_yes", "n_no", "mean_yes", "mean_no", F.col("p").alias("welch_p"), "cohen_d")
    raw = d.groupBy("label").agg(F.avg(F.when(F.col("x") == 1, F.col("raw"))).alias("raw_mean_yes"), F.avg(F.when(F.col("x") == 0, F.col("raw"))).alias("raw_mean_no"), F.count_distinct(F.when(F.col("x") == 1, F.col(person))).alias("yes_people"), F.count_distinct(person).alias("people"))
    m = mixed_model(d, person, "x", "y", by=("label",)).select("label", *[F.col(c).alias(f"mixed_{c}") for c in ("estimate", "se", "p", "low", "high", "icc", "lrt_p")])
    r = spearman_by_group(d.withColumn("one", F.struct("label", person)), "one", "x", "y", least_days).groupBy("one.label").agg(F.count("r").alias("ranked_people"), F.percentile("r", F.lit(0.5)).alias("median_r"), (100 * F.avg((F.round("r", 9) > 0).cast("int"))).alias("positive_pct"))
    return t.join(raw, "label").join(m, "label", "left").join(r, "label", "left").fillna(0, ["ranked_people"])


def _profile(r: DataFrame, keys: list[str]) -> DataFrame:
    """Fits of each model (keys) at each ratio of its grid: group sums with i and ratio."""
    w = F.col("ratio") / (1 + F.col("n") * F.col("ratio"))
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    a = r.groupBy(*keys, "i", "ratio").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"), F.sum(n - w * n * n).alias("a11"), F.sum(x - w * n * x).alias("a12"), F.sum(F.col("xx") - w * x * x).alias("a22"), F.sum(y - w * n * y).alias("b1"), F.sum(F.col("xy") - w * x * y).alias("b2"), F.sum(F.col("yy") - w * y * y).alias("c"), F.sum(F.ln(1 + n * F.col("ratio"))).alias("ld"))
    det = F.col("a11") * F.col("a22") - F.col("a12") * F.col("a12")
    a = a.withColumn("det", det).where("det > 1e-12").withColumn("estimate", (F.col("a11") * F.col("b2") - F.col("a12") * F.col("b1")) / F.col("det"))
    a = a.withColumn("intercept", (F.col("a22") * F.col("b1") - F.col("a12") * F.col("b2")) / F.col("det"))
    loglik = lambda rss: -0.5 * (F.col("rows") * (F.ln(2 * math.pi * rss / F.col("rows")) + 1) + F.col("ld"))
    rss = F.col("c") - F.col("b1") * F.col("intercept") - F.col("b2") * F.col("estimate")
    a = a.withColumn("residual", rss / F.col("rows"))
    return a.select(*keys, "i", "ratio", "groups", "rows", "estimate", "intercept", F.sqrt(F.col("residual") * F.col("a11") / F.col("det")).alias("se"), "residual", loglik(rss).alias("loglik"), loglik(F.col("c") - F.col("b1") * F.col("b1") / F.col("a11")).alias("loglik0"))
