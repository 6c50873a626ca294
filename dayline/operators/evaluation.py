"""Evaluation of recommendations: burden, specificity, pass rates and their decomposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayline.functions.columns import minutes_of

#: Verbs of a change and their weight; minutes of a slot and theirs.
VERBS = [(("cancel", "drop", "skip", "replace"), 1.3), (("move", "reschedule", "shift", "delay", "push"), 1.0), (("add", "insert", "schedule", "protect"), 0.7), (("cap", "shorten", "trim"), 0.5)]
TIERS = [(20, 0.2), (45, 0.45), (90, 0.8)]
LONGEST, HIGH = 1.2, 2.5


def burden(change: Column, start: Column, end: Column) -> Column:
    """Burden of one suggestion: its verbs, and how long its slot is."""
    text = F.lower(F.coalesce(change, F.lit("")))
    score = sum((F.when(text.rlike("|".join(words)), weight).otherwise(0.0) for words, weight in VERBS), F.lit(0.0))
    minutes = minutes_of(end) - minutes_of(start)
    slot = F.when(minutes.isNull(), 0.0)
    for most, weight in TIERS:
        slot = slot.when(minutes <= most, weight)
    return score + slot.otherwise(LONGEST)


def burden_score(suggestions: DataFrame, case: str = "case_id") -> DataFrame:
    """Sum for each case of (case, change, start_time, end_time), and whether it is high."""
    s = suggestions.groupBy(case).agg(F.round(F.sum(burden(F.col("change"), F.col("start_time"), F.col("end_time"))), 3).alias("burden"))
    return s.withColumn("high_burden", F.col("burden") >= HIGH)


def burden_ok(score: Column, adherence: Column) -> Column:
    return score <= 0.65 + 2.15 * adherence


def specific(change: Column, start: Column, end: Column, names: Column) -> Column:
    """Whether a suggestion has both times or names a flexible event; an empty one never is."""
    text = F.lower(F.coalesce(change, F.lit("")))
    timed = F.coalesce(start.rlike(r"^\d\d:\d\d$") & end.rlike(r"^\d\d:\d\d$"), F.lit(False))
    return (F.trim(text) != "") & (timed | F.exists(names, lambda n: (n != "") & F.contains(text, n)))


def rates(arms: DataFrame, by: list[str], passes: list[str]) -> DataFrame:
    return arms.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("int")).alias(c) for c in passes])


def with_total(arms: DataFrame, by: str, passes: list[str]) -> DataFrame:
    """Rates by a column and over all rows, in one pass."""
    r = arms.rollup(by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("int")).alias(c) for c in passes])
    return r.withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit("all")))


def on_cases(arms: DataFrame, cases: DataFrame, passes: list[str]) -> DataFrame:
    """Rates by arm over the cases in `cases`."""
    return rates(arms.join(cases.select("case_id").distinct(), "case_id", "left_semi"), ["arm"], passes)


def credit_decomposition(arms: DataFrame, flag: str, passes: str) -> DataFrame:
    """Rates with and without evidence in each arm, and the whole rate put together from them."""
    f = F.col(flag)
    s = arms.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_if(f).alias("n_with"), F.avg(F.when(f, F.col(passes).cast("int"))).alias("rate_with"), F.avg(F.when(~f, F.col(passes).cast("int"))).alias("rate_without"), F.avg(F.col(passes).cast("int")).alias("rate"))
    whole = (F.col("n_with") * F.coalesce("rate_with", F.lit(0.0)) + (F.col("n") - F.col("n_with")) * F.coalesce("rate_without", F.lit(0.0))) / F.col("n")
    return s.withColumn("reconstructed", whole)


def blind_pairs(pairs: DataFrame, seed: str = "blind") -> DataFrame:
    """(case_id, side, arm, text): the two arms of a case as sides A and B, swapped by a hash of the case."""
    swap = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "case_id").cast("binary")), 1, 2), 16, 10).cast("int") % 2 == 1
    p = pairs.withColumn("swap", swap)
    side = lambda name, one, two: F.struct(F.lit(name).alias("side"), F.when(F.col("swap"), F.lit(two)).otherwise(F.lit(one)).alias("arm"), F.when(F.col("swap"), F.col(two)).otherwise(F.col(one)).alias("text"))
    arms = [c for c in pairs.columns if c != "case_id"]
    return p.select("case_id", F.explode(F.array(side("A", arms[0], arms[1]), side("B", arms[1], arms[0]))).alias("s")).select("case_id", "s.*")


def rater_summary(ratings: DataFrame, key: DataFrame) -> DataFrame:
    """Mean rating by arm after unblinding, and the share of cases that prefer it (one preference a case)."""
    r = ratings.join(key.select("case_id", "side", "arm"), ["case_id", "side"])
    best = Window.partitionBy("case_id").orderBy(F.col("rating").desc(), "side")
    r = r.withColumn("preferred", F.row_number().over(best) == 1)
    return r.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("mean_rating"), F.avg(F.col("preferred").cast("int")).alias("preference_rate"))


#: Verbs that change an event, how near to its title they count, and words of a support block.
CHANGES = "move|moving|reschedule|cancel|shorten|replace|delay|push|cap|skip|drop"
NEAR = 48
SUPPORT = ["add", "buffer", "wind-down", "walk", "block", "break", "light"]
#: Words that name a pattern's mechanism, markers that ground it, words of an action that fits it.
MECHANISM = {
    "phone-mediated-sleep-delay": ["late-night screen", "screen use", "screen exposure", "phone", "device", "blue light", "screen spillover"],
    "behavioral-withdrawal": ["behavioral withdrawal", "reduced mobility", "mobility entropy", "location routine", "familiar places", "third place", "outside", "walk"],
    "circadian-instability": ["circadian", "sleep regularity", "regularity", "consistent wake", "wake time", "anchor", "social rhythm", "routine timing"],
    "fragmented-attention-with-sleep-loss": ["fragmented attention", "app switching", "attention", "focus", "sleep loss", "sleep debt", "cognitive strain"],
}
GROUNDS = {
    "phone-mediated-sleep-delay": ["sleep_onset_hour", "late_night_screen_min"],
    "behavioral-withdrawal": ["mobility_entropy", "location_revisit_ratio", "social_rhythm_metric"],
    "circadian-instability": ["sleep_regularity_index", "sleep_onset_hour", "social_rhythm_metric"],
    "fragmented-attention-with-sleep-loss": ["app_switching_rate", "sleep_duration_hours"],
}
ACTIONS = {
    "phone-mediated-sleep-delay": ["wind-down", "no screens", "screen", "phone"],
    "behavioral-withdrawal": ["walk", "outside", "social", "third place", "workout"],
    "circadian-instability": ["wake", "morning", "anchor", "routine", "light"],
    "fragmented-attention-with-sleep-loss": ["focus", "deep work", "study block", "sleep"],
}


def _any_of(text: Column, found: Column) -> Column:
    return F.coalesce(F.exists(found, lambda w: F.contains(text, w)), F.lit(False))


def fixed_protection(texts: DataFrame, events: DataFrame) -> DataFrame:
    """(case_id, passed, touched) of (case_id, text): no fixed event is changed, and a flexible one or a support block is meant.

    `events`: (case_id, title, event_type, fixed). A fixed event is changed when one of the verbs stands within 48
    characters of its title. One equi-join on the case, one aggregation; blank text never passes.
    """
    t = texts.select("case_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    title = F.lower("title")
    quoted = F.regexp_replace(title, r"([^\p{L}\p{N} ])", r"\\$1")
    near = F.concat(F.lit(rf"\b({CHANGES})\b.{{0,{NEAR}}}\b"), quoted, F.lit(r"\b|\b"), quoted, F.lit(rf"\b.{{0,{NEAR}}}\b({CHANGES})\b"))
    named = F.contains(F.col("text"), title)
    kind = F.contains(F.col("text"), F.lower(F.translate("event_type", "_", " ")))
    changed = F.coalesce(F.col("fixed") & named & F.rlike(F.col("text"), near), F.lit(False))
    meant = F.coalesce(~F.col("fixed") & (named | kind), F.lit(False))
    support = _any_of(F.col("text"), F.array(*[F.lit(w) for w in SUPPORT]))
    c = t.join(events, "case_id", "left").groupBy("case_id").agg(F.max(F.trim("text") != "").alias("said"), F.max(changed).alias("changed"), F.max(meant | support).alias("aimed"), F.array_sort(F.collect_set(F.when(changed, F.col("title")))).alias("touched"))
    return c.select("case_id", (F.col("said") & ~F.col("changed") & F.col("aimed")).alias("passed"), "touched")


def lever_credit(pattern: Column, text: Column, grounds: Column, informed: Column) -> Column:
    """Whether a recommendation meets its case's mechanism: it names it, or, if `informed`, rests on its markers or fits it."""
    listed = lambda words: F.create_map(*[x for p, ws in words.items() for x in (F.lit(p), F.array(*[F.lit(w) for w in ws]))])[pattern]
    said, rests = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(grounds, F.lit("")))
    based = F.coalesce(F.contains(rests, pattern), F.lit(False)) | _any_of(rests, listed(GROUNDS))
    return _any_of(said, listed(MECHANISM)) | (F.coalesce(informed, F.lit(False)) & (based | _any_of(said, listed(ACTIONS))))


def decision_cases(cases: DataFrame, states: DataFrame, loads: DataFrame, results: DataFrame, aware: str) -> DataFrame:
    """One row per case and arm: the case (case_id, pid, day, pattern), its state's names, its day's load and the arm's results.

    `states` (pid, day, early, later: arrays of names) and `loads` (pid, day, ...) meet the cases on (pid, day),
    `results` (case_id, arm, ...) on the case. A pattern is detected when either array names it; only the arm `aware`
    counts as having had that evidence.
    """
    c = cases.join(states, ["pid", "day"], "left").join(loads, ["pid", "day"], "left")
    none = F.array().cast("array<string>")
    c = c.withColumn("names", F.array_sort(F.array_union(F.coalesce("early", none), F.coalesce("later", none)))).drop("early", "later")
    c = c.withColumn("detected", F.coalesce(F.array_contains("names", F.col("pattern")), F.lit(False)))
    return c.join(results, "case_id").withColumn("evidence", F.col("detected") & (F.col("arm") == aware))
