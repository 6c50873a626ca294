"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode only (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors. It goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def running_total(df: DataFrame, by: str, value: str, out: str, most: int = 1_000_000) -> DataFrame:
    """`df` with the sum of `value` over the rows before each in order of `by`, whose values are distinct.

    Up to `most` counted rows are summed in one task. More are range-partitioned: each range sums its own rows, and
    only the totals of the ranges, a row for each, are summed in one task.
    """
    df = staged(df, "totals")
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if df.count() <= most:
        return df.withColumn(out, before(Window.orderBy(by), value))
    parts = staged(df.repartitionByRange(by).withColumn("_part", F.spark_partition_id()), "ranges")
    starts = parts.groupBy("_part").agg(F.sum(value).alias("_total")).select("_part", before(Window.orderBy("_part"), "_total").alias("_start"))
    return parts.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + before(Window.partitionBy("_part").orderBy(by), value)).drop("_part", "_start")
