"""Readers of raw exports: explicit schemas, quirks handled in the plan, malformed rows dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ZONE = "-04:00"


def local_time(epoch_seconds: Column, zone: str = ZONE) -> Column:
    """A zone's clock time of an epoch."""
    return F.from_utc_timestamp(F.timestamp_seconds(epoch_seconds), zone).cast("timestamp_ntz")


#: A participant in the name of a file; a folder's name can be asked for instead.
PID = r"(u\d+)[^/]*$"


def with_pid(df: DataFrame, pattern: str | None = PID) -> DataFrame:
    """Adds `pid` from the path of the file that a row is read from; all files are one scan.

    Without a pattern the rows bring their own: a folder for each of many participants costs more to write, list and
    open than its rows do, so that many share a file whose first column is `pid`.
    """
    if pattern is None:
        return df.withColumn("pid", F.trim("pid"))
    return df.withColumn("pid", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def _own(pattern: str | None) -> str:
    return "pid string, " if pattern is None else ""


def _named(pattern: str | None) -> list[str]:
    return ["pid"] if pattern is None else []


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("enforceSchema", True).csv(path)


def read_intervals(spark: SparkSession, path: str, zone: str = ZONE, pid: str | None = PID) -> DataFrame:
    """(pid, start, end) of files whose first two columns are epochs; rows that don't end after their start are dropped."""
    raw = with_pid(spark.read.option("header", True).schema(_own(pid) + "start string, end string").csv(path).select("*", "_metadata"), pid)
    e = raw.select("pid", F.trim("start").try_cast("double").alias("s"), F.trim("end").try_cast("double").alias("e")).where("e > s")
    return e.select("pid", local_time(F.col("s"), zone).alias("start"), local_time(F.col("e"), zone).alias("end"))


def read_locations(spark: SparkSession, path: str, zone: str = ZONE, pid: str | None = PID) -> DataFrame:
    """(pid, time, location) of files with a comma at the end of each row; blank places are dropped."""
    raw = with_pid(spark.read.option("header", True).schema(_own(pid) + "time string, location string, rest string").csv(path).select("*", "_metadata"), pid)
    t = raw.select("pid", F.trim("time").try_cast("double").alias("t"), F.trim("location").alias("location")).where("t is not null and location <> ''")
    return t.select("pid", local_time(F.col("t"), zone).alias("time"), "location")


def read_apps(spark: SparkSession, path: str, time: str = "timestamp", package: str = "RUNNING_TASKS_topActivity_mPackage", zone: str = ZONE, pid: str | None = PID) -> DataFrame:
    """(pid, time, package): two of many columns."""
    raw = with_pid(_csv(spark, path).select(*_named(pid), time, package, "_metadata"), pid)
    t = raw.select("pid", F.col(time).try_cast("double").alias("t"), F.col(package).alias("package")).where("t is not null and package is not null")
    return t.select("pid", local_time(F.col("t"), zone).alias("time"), "package")


def read_comm(spark: SparkSession, path: str, kind: str, zone: str = ZONE, pid: str | None = PID) -> DataFrame:
    """(pid, time, outgoing, channel) of message or call files with epochs in milliseconds; type 2 goes out."""
    prefix = {"sms": "MESSAGES", "call": "CALLS"}[kind]
    raw = with_pid(_csv(spark, path).select(*_named(pid), f"{prefix}_date", f"{prefix}_type", "_metadata"), pid)
    t = raw.select("pid", F.col(f"{prefix}_date").try_cast("double").alias("t"), F.col(f"{prefix}_type").try_cast("int").alias("k")).where("t is not null and k is not null")
    return t.select("pid", local_time(F.col("t") / 1000, zone).alias("time"), (F.col("k") == 2).alias("outgoing"), F.lit(kind).alias("channel"))


def read_answers(spark: SparkSession, path: str, fields: list[str], zone: str = ZONE, pid: str = PID) -> DataFrame:
    """(pid, day, hour of the answer, fields as text) of JSON arrays with resp_time; answers without it are dropped."""
    schema = "resp_time double, " + ", ".join(f"{f} string" for f in fields)
    raw = with_pid(spark.read.option("multiLine", True).schema(schema).json(path).select("*", "_metadata"), pid).where("resp_time is not null")
    at = local_time(F.col("resp_time"), zone)
    return raw.select("pid", F.to_date(at).alias("day"), (F.hour(at) + F.minute(at) / 60).alias("answered"), *fields)


def read_feedback(spark: SparkSession, path: str, schema: str = "timestamp string, suggestion_change string, action string, behavioral_summary string") -> DataFrame:
    """JSON lines; malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_corpus(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """A CSV of texts, trimmed; blank texts are dropped."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).withColumn(text, F.trim(text)).where(F.col(text) != "")


#: What stands before each entry of a journal export, and between its head and its content.
RULER, DASHES = "=" * 40, "-" * 40


def newest_file(spark: SparkSession, path: str) -> str | None:
    """Of the files at `path` (a glob) the one that was changed last; names with a dot in front don't count, contents aren't read."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime").where(~F.element_at(F.split("path", "/"), -1).startswith("."))
    found = files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()
    return found[0]


def read_journals(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Entries (id, number, created, period, content) of the newest journal export at `path` (a glob), the last number first.

    Spark's text source cuts the file at its rulers while it reads, so a file of any length is split over tasks and no
    text of a whole file is ever held. What isn't an entry is skipped; an entry without a number counts as number 0, one
    without a line of dashes is content as a whole.
    """
    newest = newest_file(spark, path)
    e = journal_entries(spark.read.option("lineSep", RULER).text(newest)).orderBy(F.col("number").desc(), "created")
    return e.limit(limit) if limit else e


def journal_entries(parts: DataFrame) -> DataFrame:
    """(id, number, created, period, content) of texts `value` between rulers; further columns stay."""
    get = lambda p: F.regexp_extract("value", p, 1)
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    number = F.coalesce(get(r"JOURNAL ENTRY #(\d+)").try_cast("int"), F.lit(0))
    dashed = r"(?s)-{20,}\s*\n\n(.+)"
    content = strip(F.when(F.col("value").rlike(dashed), get(dashed)).otherwise(F.regexp_replace("value", r"^=+", "")))
    rest = [c for c in parts.columns if c != "value"]
    e = parts.where(F.contains("value", F.lit("JOURNAL ENTRY")))
    return e.select(*rest, F.concat(F.lit("entry_"), number.cast("string")).alias("id"), number.alias("number"), get(r"Created At: ([\d\-: ]+)").alias("created"), get(r"Period: (.+)").alias("period"), content.alias("content"))


def write_logs(logs: DataFrame, path: str) -> None:
    """Writes logs (id, timestamp, type, content) so that scans by time and by type read only what they need: a folder for each day and type, rows in order of time."""
    day = logs.withColumn("day", F.to_date("timestamp"))
    day.repartitionByRange("day", "type", "timestamp").sortWithinPartitions("day", "type", "timestamp", "id").write.partitionBy("day", "type").parquet(path)


def logs_between(logs: DataFrame, start: Column, end: Column) -> DataFrame:
    """Written logs from `start` to `end`, both within, oldest first; only the days between are read."""
    days = F.col("day").between(F.to_date(start), F.to_date(end))
    return logs.where(days & F.col("timestamp").between(start, end)).orderBy("timestamp", "id")


def logs_by_type(logs: DataFrame, kind: str) -> DataFrame:
    """Written logs of one type, oldest first; only that type's folders are read."""
    return logs.where(F.col("type") == kind).orderBy("timestamp", "id")


def recent_logs(logs: DataFrame, n: int = 50) -> DataFrame:
    """The `n` newest of written logs, newest first, without sorting more than the newest days that hold as many.

    Rows are counted by day, which reads no column but the folders' names; each task then keeps its own n newest.
    """
    newest = Window.orderBy(F.col("day").desc())  # a row for each day
    per_day = logs.groupBy("day").agg(F.count(F.lit(1)).alias("rows")).withColumn("newer", F.sum("rows").over(newest) - F.col("rows"))
    since = per_day.where(F.col("newer") < n).agg(F.min("day")).first()[0]
    return logs.where(F.col("day") >= F.lit(since)).orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(n)


def decode_logs(logs: DataFrame, kind: str, schema: str) -> DataFrame:
    """Payloads of one type as columns; rows that don't parse are dropped."""
    d = logs.where(F.col("type") == kind).withColumn("_d", F.from_json("content", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    return d.where("_d is not null and _d._bad is null").select("id", "timestamp", "_d.*").drop("_bad")


def decode_sleep_states(logs: DataFrame) -> DataFrame:
    """(id, event, time, lux) of sleep-state payloads, read field by field, so that broken JSON still counts; without event or time a row is dropped."""
    field = lambda name, value: F.regexp_extract("content", rf'"{name}"\s*:\s*{value}', 1)
    d = logs.where(F.col("type") == "sleep_state").select("id", field("event", r'"(\w+)"').alias("event"), F.timestamp_millis(field("ts", r"(\d+)").try_cast("long")).alias("time"), field("lux", r"([\d.]+)").try_cast("double").alias("lux"))
    return d.where("event <> '' and time is not null")


def write_table(df: DataFrame, path: str, fmt: str) -> None:
    """CSV with a header and doubled quotes, JSON lines or Parquet."""
    (df.write.option("header", True).option("escape", '"') if fmt == "csv" else df.write).format(fmt).save(path)


def journal_blocks(journals: DataFrame) -> DataFrame:
    """(user, number, block): each user's journals (user, created, start, end, content) as numbered blocks, in order of creation."""
    n = F.row_number().over(Window.partitionBy("user").orderBy("created", "content"))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    head = [F.lit(RULER + "\nJOURNAL ENTRY #"), F.col("number").cast("string"), F.lit("\nCreated At: "), at("created"), F.lit("\nPeriod: "), at("start"), F.lit(" TO "), at("end"), F.lit("\n" + DASHES + "\n\n")]
    return journals.withColumn("number", n).select("user", "number", F.concat(*head, F.coalesce("content", F.lit("")), F.lit("\n\n")).alias("block"))


def export_journals(journals: DataFrame, path: str) -> None:
    """Writes a folder of export files for each user, blocks in order of their numbers.

    Blocks are range-partitioned by user and number: a user with many is spread over several files, in order of their names.
    """
    blocks = journal_blocks(journals).repartitionByRange("user", "number").sortWithinPartitions("user", "number")
    blocks.select("user", "block").write.partitionBy("user").option("lineSep", "\n").text(path)


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all users' exports that `export_journals` wrote, with `user`."""
    return journal_entries(spark.read.option("lineSep", RULER).text(path))
