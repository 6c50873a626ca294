"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, `[\x20\x09-\x0D]`, as a class body for Java and RE2 patterns.
SPACE = r"\x20\x09-\x0D"


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


def held_out(doc_id: Column, modulus: int) -> Column:
    """True where crc32 of the id's decimal text leaves 2 modulo `modulus`; a null id is training data."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == 2, F.lit(False))


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8, A-Z lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHash(dict):
    """xxh3-64 of words, remembered for up to `most` of them."""

    def __init__(self, most: int = 200_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def small_batches(spark: SparkSession, most: int = 1000) -> None:
    """Sets the session's Arrow batches to `most` rows at most: a row here is a whole text, and a task holds a batch of them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= most:
        spark.conf.set(key, most)


def semi_join(rows: DataFrame, ids: DataFrame, on: str, most: int = 500_000) -> DataFrame:
    """Rows whose `on` is in `ids`. Up to `most` counted ids (8 bytes each) are sent to all tasks, so that the rows needn't move."""
    ids = staged(ids, "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= most else ids, on, "left_semi")
