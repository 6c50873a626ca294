"""Mixing sources to target weights by systematic sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayline.llm.common import SPACE, staged

#: Weights of the sources by rank of their code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most this many times its own size.
MOST = 3


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds `target` to a table (source, source_size): shares of the whole by weight, no source above `most` times its size.

    What exceeds a source's limit is shared again by weight. The fixed point of that is least(limit, weight * level)
    for one level, found by sorting the sources by limit / weight: the table of sources is small, so one task does it.
    """
    by_name, by_cap = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("cap_per_weight", F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    s = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", F.col("source_size").cast("double") * most).withColumn("cap_per_weight", F.col("cap") / F.col("weight"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
    # the level holds from the first source on that stays under its limit; without one all are at their limits
    s = s.withColumn("level", F.min(F.when(F.col("level") < F.col("cap_per_weight"), F.struct(F.col("cap_per_weight"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(whole)["level"])
    return s.select("source", "source_size", F.coalesce(F.least("cap", F.col("weight") * F.col("level")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows of `docs` (doc_id, text, source; others kept out) with size, source_size, target, copies and taken, and its columns in `carry`.

    Every document of a source is expected target / source_size times. Along the order (size class, md5 of the id,
    size, id) of its source the expected copies are summed up, one offset drawn by md5 from the seed and the source's
    name is added, and a document is emitted once per integer boundary that its step crosses: floor or ceiling of its
    expectation, so never more than `most` times. The order by size class keeps the words taken near the target.

    Prefix sums never need a source in one task: rows are numbered within chunks (source, size class, first two md5
    digits), and only the bounded table of chunk counts is summed along a source. Rows with null text have size 0 and
    are never counted as words; null sources form the last source; repeated rows each count; reruns agree because no
    step depends on partitions. An empty table gives an empty table.
    """
    digits = F.length(F.col("size").cast("string"))
    slim = staged(
        docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *carry)
        .withColumn("digest", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
        .withColumn("grade", (digits * 1000 + F.substring(F.col("size").cast("string"), 1, 3).cast("int")).cast("int"))
        .withColumn("slot", F.substring("digest", 1, 2)),
        "mix-sizes",
    )
    chunks = staged(slim.groupBy("source", "grade", "slot").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("chunk_size")), "mix-chunks")
    target = targets(chunks.groupBy("source").agg(F.sum("chunk_size").alias("source_size")), weights, most)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce("source", F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    target = target.withColumn("rate", rate).withColumn("offset", offset)
    along = Window.partitionBy("source").orderBy("grade", "slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = chunks.withColumn("start", F.coalesce(F.sum("n").over(along), F.lit(0))).drop("n", "chunk_size")
    starts = starts.join(target, starts.source.eqNullSafe(target.source)).drop(target.source)
    starts = starts.select(F.col("source").alias("s"), F.col("grade").alias("g"), F.col("slot").alias("d"), "start", "source_size", "target", "rate", "offset")
    rows = slim.join(starts, slim.source.eqNullSafe(starts.s) & (slim.grade == starts.g) & (slim.slot == starts.d))
    place = F.col("start") + F.row_number().over(Window.partitionBy("source", "grade", "slot").orderBy("digest", "size", "doc_id", *carry))
    rows = rows.withColumn("place", place)
    copies = F.floor(F.col("place") * F.col("rate") + F.col("offset")) - F.floor((F.col("place") - 1) * F.col("rate") + F.col("offset"))
    return rows.withColumn("copies", copies.cast("long")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carry)
