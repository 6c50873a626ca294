"""Replays a table as a stream: its rows arrive in steps, and a job takes up after each where it stopped."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import IntegerType, StructField, StructType

from dayline.functions.staging import shared_dir


@contextlib.contextmanager
def stream_settings(spark: SparkSession) -> Iterator[None]:
    """A session in UTC with the RocksDB state store, as stateful jobs need it; set back afterwards."""
    wanted = {"spark.sql.session.timeZone": "UTC", "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def feed(rows: DataFrame, step: Column, steps: int, start: Callable[[DataFrame, str], DataStreamWriter], name: str) -> str:
    """Writes the rows of each `step` (0 to steps - 1) to a folder and lets a job take in what is new there; returns the job's folder.

    `start` gets the stream and the job's folder and gives the writer. Each step is a run of its own from the checkpoint
    before (availableNow), as a job is that is started now and then; the watermark moves between steps. `rows` are
    worked out once, and written by step.
    """
    spark = rows.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    rows.withColumn("_step", step.cast("int")).write.partitionBy("_step").parquet(f"{folder}/steps")
    sorted_out = spark.read.schema(StructType([*rows.schema.fields, StructField("_step", IntegerType())])).parquet(f"{folder}/steps")
    for i in range(steps):
        sorted_out.where(F.col("_step") == i).drop("_step").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        start(stream, folder).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return folder


def replay(rows: DataFrame, step: Column, steps: int, job: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What a job in append mode gives out over rows that arrive in steps; exactly once, by the file sink's log."""
    with stream_settings(rows.sparkSession):
        folder = feed(rows, step, steps, lambda stream, to: job(stream).writeStream.format("parquet").outputMode("append").option("path", f"{to}/out"), name)
        return rows.sparkSession.read.parquet(f"{folder}/out")


def replay_batches(rows: DataFrame, step: Column, steps: int, job: Callable[[DataFrame], DataFrame], ingest: Callable[[str], Callable[[DataFrame, int], None]], name: str) -> str:
    """Feeds each batch of a job over rows that arrive in steps to `ingest` of the store's folder, which is returned."""
    with stream_settings(rows.sparkSession):
        folder = feed(rows, step, steps, lambda stream, to: job(stream).writeStream.foreachBatch(ingest(f"{to}/store")), name)
        return f"{folder}/store"


def arrival(ts: Column, bounds: list[str]) -> Column:
    """The step of a row that arrives in time: how many of the bounds, texts of times, lie at or before it."""
    return sum((F.when(ts >= F.lit(b).cast("timestamp"), 1).otherwise(0) for b in bounds), F.lit(0))
