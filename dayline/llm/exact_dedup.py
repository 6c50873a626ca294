"""Exact deduplication by content sort, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayline.llm.common import staged

#: A text is hot when it has more than this share of all rows; so at most 1 / HOT_SHARE texts are hot.
HOT_SHARE = 1 / 128
#: A hot text's rows are spread over so many parts of the range.
PARTS = 64
#: Characters of the normalised text in a range splitter.
SPLITTER = 24


def normalised(text: Column) -> Column:
    """The text without `[\\x20\\x09-\\x0D]`; empty for null."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def exact_duplicates(docs: DataFrame, hot_share: float = HOT_SHARE, parts: int = PARTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of `docs` (doc_id, text; others ignored).

    Texts are equal when their normalised bytes are. Sampled splitters (start of the text, its hash, part) deal the
    normalised texts over ranges, each range is sorted on disk, and rows whose whole normalised texts equal their
    neighbour's form a group; the row with the most code points in its original text, then the smallest id, stays.
    The texts cross the network once. Texts that hold more than `hot_share` of the rows are spread over `parts` parts,
    and only the parts of these few are put together by digest afterwards.

    Null text counts as empty; all empty texts are one group. A null doc_id sorts after all others, so it stays only
    where no other row does; rows repeated whole count as members, and exactly the rows whose id is keep_id are kept.
    An empty table gives an empty table.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), normalised(F.col("text")).alias("norm")).withColumn("h", F.xxhash64("norm"))
    most = max(docs.count() * hot_share, 1)
    hot = staged(text.groupBy("h").count().where(F.col("count") > most).select("h", F.lit(True).alias("hot")), "exact-hot")
    text = text.join(F.broadcast(hot), "h", "left").withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(parts))).otherwise(0))
    keys = ["start", "h", "part"]
    ranged = text.withColumn("start", F.substring("norm", 1, SPLITTER)).repartitionByRange(*keys)
    same = Window.partitionBy(*keys, "norm")
    best = same.orderBy(F.col("n").desc(), F.col("doc_id").asc_nulls_last())
    grouped = ranged.withColumn("keep_id", F.first("doc_id").over(best)).withColumn("group_size", F.count(F.lit(1)).over(same))
    slim = staged(grouped.select("doc_id", "n", "keep_id", "group_size", "hot", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")), "exact-rows")
    whole = slim.where("hot").groupBy("text_sha256").agg(F.min(F.struct(-F.col("n"), F.col("doc_id").isNull(), F.col("doc_id")))["doc_id"].alias("whole_id"), F.count(F.lit(1)).alias("whole_size"))
    out = slim.join(F.broadcast(whole), "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("hot"), F.col("whole_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(F.col("hot"), F.col("whole_size")).otherwise(F.col("group_size")).alias("group_size"),
        "text_sha256",
    )
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
