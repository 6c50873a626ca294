"""Participant warehouse: journals, enrolments, risk history, preferences and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayline.functions.staging import staged

RISKS = ["minimal", "mild", "moderate", "severe"]


def anon_id(user: Column) -> Column:
    return F.sha2(user.cast("string").cast("binary"), 256)


def sanitize_id(user: Column) -> Column:
    """The first 64 characters with anything but letters, digits, underscore and hyphen replaced."""
    return F.regexp_replace(F.substring(user, 1, 64), "[^A-Za-z0-9_-]", "_")


def first_rows(df: DataFrame, keys: list[str], order: list[Column], most: int = 1) -> DataFrame:
    """The first `most` rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def dedupe_journals(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of `fresh` (user, journal_id, place) not stored yet, one for each id; null ids are always kept."""
    known = fresh.where("journal_id is not null").join(stored.select("user", "journal_id"), ["user", "journal_id"], "left_anti")
    return first_rows(known, ["user", "journal_id"], [F.col("place")]).unionByName(fresh.where("journal_id is null"))


def risk_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in RISKS]), level)


def risk_trend(assessments: DataFrame) -> DataFrame:
    """(user, trend): mean rank of the last three against the up to three before; unknown levels don't count."""
    a = assessments.withColumn("rank", risk_rank(F.col("level"))).where("rank > 0")
    a = a.withColumn("n", F.row_number().over(Window.partitionBy("user").orderBy(F.col("place").desc()))).where("n <= 6")
    s = a.groupBy("user").agg(F.count(F.lit(1)).alias("c"), F.avg(F.when(F.col("n") <= 3, F.col("rank"))).alias("recent"), F.avg(F.when(F.col("n") > 3, F.col("rank"))).alias("prior"))
    d = F.col("recent") - F.col("prior")
    trend = F.when(F.col("c") <= 3, "insufficient_data").when(d > 0.5, "rising").when(d < -0.5, "falling").otherwise("stable")
    return assessments.select("user").distinct().join(s, "user", "left").select("user", F.coalesce(F.when(F.col("c").isNotNull(), trend), F.lit("insufficient_data")).alias("trend"))


def prompt_lines(preferences: DataFrame) -> DataFrame:
    """(user, line): explicit wishes, then what to avoid and to prefer; the first spelling of each stays, in order."""
    p = preferences.withColumn("value", F.trim("value")).where("value <> ''").withColumn("key", F.lower("value"))
    p = first_rows(p, ["user", "kind", "key"], [F.col("place")])
    lists = p.groupBy("user", "kind").agg(F.array_join(F.sort_array(F.collect_list(F.struct("place", "value")))["value"], ", ").alias("v"))
    label = F.when(F.col("kind") == "avoid", F.concat(F.lit("Avoid: "), F.col("v"))).when(F.col("kind") == "prefer", F.concat(F.lit("Prefer: "), F.col("v"))).otherwise(F.col("v"))
    return lists.select("user", "kind", label.alias("line"))


def risk_history(assessments: DataFrame, most: int = 7) -> DataFrame:
    """(user, history): the last `most` known levels, oldest first."""
    last = first_rows(assessments.where(risk_rank(F.col("level")) > 0), ["user"], [F.col("place").desc()], most)
    return last.groupBy("user").agg(F.array_join(F.sort_array(F.collect_list(F.struct("place", "level")))["level"], ",").alias("history"))


def user_context(preferences: DataFrame, assessments: DataFrame, feedback: DataFrame) -> DataFrame:
    """(user, preferences, trend, level, feedback): what is known of each user in any of the tables, with defaults for the rest.

    `preferences` are prompt_lines, `feedback` (user, feedback) is a count.
    """
    lines = preferences.groupBy("user").agg(F.array_join(F.sort_array(F.collect_list(F.struct("kind", "line")))["line"], "; ").alias("preferences"))
    latest = first_rows(assessments, ["user"], [F.col("place").desc()]).select("user", F.coalesce("level", F.lit("unknown")).alias("level"))
    j = risk_trend(assessments).join(latest, "user", "full").join(lines, "user", "full").join(feedback, "user", "full")
    return j.select("user", F.coalesce("preferences", F.lit("")).alias("preferences"), F.coalesce("trend", F.lit("insufficient_data")).alias("trend"), F.coalesce("level", F.lit("unknown")).alias("level"), F.coalesce("feedback", F.lit(0)).alias("feedback"))


#: Fields of a session document that the warehouse keeps; proposed changes stay JSON text.
SESSION = (
    "journal_summary string, wellbeing struct<risk_level: string, key_concerns: array<string>, positive_indicators: array<string>>, "
    "recommendations array<struct<category: string, action: string, when: string, when_to_do: string, priority: string, mechanism: string, source: string>>, "
    "journals array<struct<id: string, entry_number: long, period: string, content: string, created_at: string>>, proposed_changes string"
)


def explode_session(sessions: DataFrame, stored: DataFrame | None = None) -> dict[str, DataFrame]:
    """Child tables of session documents (session, user, doc as JSON), by name; users appear by their anonymous id only.

    A document without `wellbeing` or proposed changes adds no row there. Of journals with one id of one user the first
    (by session and place) is kept, and none that `stored` (user, journal_id) has; journals without an id are all kept.
    A document that isn't JSON is a session with nothing in it.
    """
    d = staged(sessions.select("session", anon_id(F.col("user")).alias("user"), F.from_json("doc", SESSION).alias("d")), "sessions")
    each = lambda field: d.select("session", "user", F.posexplode(f"d.{field}").alias("n", "r"))
    listed = lambda c: F.coalesce(F.to_json(c), F.lit("[]"))
    j = each("journals").select("session", "user", "n", F.nullif("r.id", F.lit("")).alias("journal_id"), "r.entry_number", "r.period", "r.content", "r.created_at").withColumn("place", F.struct("session", "n"))
    known = stored if stored is not None else j.select("user", "journal_id").where("false")
    return {
        "users": d.select("user").distinct(),
        "journal_sessions": d.select("session", "user", F.coalesce(F.size("d.journals"), F.lit(0)).alias("journal_count"), F.col("d.journal_summary").alias("journal_summary")),
        "wellbeing_assessments": d.where("d.wellbeing is not null").select("session", "user", "d.wellbeing.risk_level", listed("d.wellbeing.key_concerns").alias("key_concerns"), listed("d.wellbeing.positive_indicators").alias("positive_indicators")),
        "recommendations": each("recommendations").select("session", "n", "r.category", "r.action", F.coalesce(F.nullif("r.when", F.lit("")), "r.when_to_do").alias("when_to_do"), "r.priority", "r.mechanism", "r.source"),
        "raw_journals": dedupe_journals(j, known).drop("place"),
        "calendar_proposals": d.where("d.proposed_changes <> '[]'").select("session", "user", F.col("d.proposed_changes").alias("proposed_changes"), F.lit(False).alias("accepted")),
    }


def write_sessions(sessions: DataFrame, folder: str, stored: DataFrame | None = None) -> None:
    """Append every child table of explode_session to a Parquet table of its name below `folder`; new users only once."""
    spark = sessions.sparkSession
    for name, rows in explode_session(sessions, stored).items():
        path = f"{folder.rstrip('/')}/{name}"
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if name == "users" and where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            rows = rows.join(spark.read.parquet(path), "user", "left_anti")
        rows.write.mode("append").parquet(path)
