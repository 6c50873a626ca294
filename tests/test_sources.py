"""Journal exports and written device logs: formats, quirks, and what a scan reads."""

import datetime as dt
import os
import re

from pyspark.sql import functions as F

from dayline.sources import readers

T0 = dt.datetime(2024, 3, 1)


def export(entries):
    return "".join(f"{'=' * 40}\nJOURNAL ENTRY #{n}\nCreated At: 2024-03-0{n} 10:00:00\nPeriod: a{n} TO b{n}\n{'-' * 40}\n\n{text}\n\n" for n, text in entries)


def test_the_newest_export_is_read_entry_by_entry(spark, tmp_path):
    for i, (name, text) in enumerate([("all_journals_1.txt", export([(1, "old")])), ("all_journals_2.txt", "intro\n" + export([(1, "first\n\nline --- and === more "), (2, "second")]) + "=" * 57 + "\nnoise\n" + "=" * 40 + "\nJOURNAL ENTRY without number"), (".all_journals_3.txt", export([(9, "trash")])), ("other.txt", export([(8, "other")]))]):
        (tmp_path / name).write_text(text, encoding="utf-8")
        os.utime(tmp_path / name, (i + 1, i + 1))
    got = readers.read_journals(spark, f"{tmp_path}/all_journals_*.txt").collect()
    assert [tuple(r) for r in got] == [
        ("entry_2", 2, "2024-03-02 10:00:00", "a2 TO b2", "second"),
        ("entry_1", 1, "2024-03-01 10:00:00", "a1 TO b1", "first\n\nline --- and === more"),
        ("entry_0", 0, "", "", "JOURNAL ENTRY without number"),
    ]
    assert [r.number for r in readers.read_journals(spark, f"{tmp_path}/all_journals_*.txt", 1).collect()] == [2]


def test_exports_come_back_and_a_large_file_is_read_in_parts(spark, tmp_path):
    rows = [(u, T0 + dt.timedelta(hours=i), T0, T0 + dt.timedelta(days=1), f"day {i}\n\ntext é {'x' * (i % 50)}") for u, n in (("a", 300), ("b c", 2), ("d", 1)) for i in range(n)] + [("d", T0, T0, T0, None)]
    j = spark.createDataFrame(rows, "user string, created timestamp_ntz, start timestamp_ntz, end timestamp_ntz, content string").repartition(3)
    readers.export_journals(j, f"{tmp_path}/out")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        read = readers.read_exports(spark, f"{tmp_path}/out")
        parts = read.rdd.getNumPartitions()
        got = sorted((r.user, r.number, r.created, r.content) for r in read.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = []
    for u in ("a", "b c", "d"):
        mine = sorted(((c, t or "") for v, c, _, _, t in rows if v == u))
        want += [(u, n + 1, str(c), t.strip()) for n, (c, t) in enumerate(mine)]
    assert got == want and parts > 3


def logs(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(hours=7 * (i % 97)), ["battery", "context", "sleep"][i % 3], "{}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, timestamp timestamp_ntz, type string, content string")
    readers.write_logs(df, f"{tmp_path}/logs")
    return rows, spark.read.schema("id long, timestamp timestamp_ntz, content string, day date, type string").parquet(f"{tmp_path}/logs")


def partition_filters(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.search(r"PartitionFilters: \[([^\]]*)\]", plan)[1]


def test_scans_of_written_logs_read_only_their_folders(spark, tmp_path):
    rows, table = logs(spark, tmp_path)
    lo, hi = rows[10][1], rows[20][1]
    between = readers.logs_between(table, F.lit(lo), F.lit(hi))
    assert "day#" in partition_filters(between)
    assert [r.id for r in between.collect()] == [i for t, i in sorted((r[1], r[0]) for r in rows) if lo <= t <= hi]
    kind = readers.logs_by_type(table, "sleep")
    assert "type#" in partition_filters(kind)
    assert [r.id for r in kind.collect()] == [i for t, i in sorted((r[1], r[0]) for r in rows if r[2] == "sleep")]


def test_recent_logs_sort_only_the_newest_days(spark, tmp_path):
    rows, table = logs(spark, tmp_path)
    for n in (1, 50, 299, 1000):
        got = readers.recent_logs(table, n)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" in plan and "day#" in partition_filters(got)
        assert [r.id for r in got.collect()] == [i for _, i in sorted(((r[1], r[0]) for r in rows), reverse=True)][:n]
    assert readers.recent_logs(table.where("false"), 5).count() == 0


def test_many_participants_share_a_bounded_number_of_files(spark, tmp_path):
    from dayline.functions.staging import shared_dir
    from dayline.plans import source_queries

    shared_dir(spark)
    lines = spark.range(300).select(F.col("id").alias("pid"), F.concat_ws(",", F.col("id") + 10, F.col("id") + 20).alias("line"))
    path = source_queries._bundled(lines, " pid , start , end ", ["x,9", "5,5", "7,", ""], "bundled", 4)
    assert len(spark.read.format("binaryFile").load(path).select("path").collect()) == 4
    got = readers.read_intervals(spark, path, pid=None)
    assert sorted(r.pid for r in got.collect()) == sorted(f"u{i}" for i in range(300)) and {(r.end - r.start).seconds for r in got.collect()} == {10}
