"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayline.llm.common import staged

#: Rows that a source partition holds on average, unless that makes more than MOST_PARTITIONS.
ROWS_PER_PARTITION, MOST_PARTITIONS = 50_000, 65_536
#: Parts of a shard that are permuted on their own.
PARTS = 256


def matrix_row(before: np.ndarray, partition: int, shards: int, seed: int) -> np.ndarray:
    """How many rows of one partition go to each shard, in an exact multivariate hypergeometric matrix; `before` sums the partitions' rows up.

    The partitions are halved again and again. What the left half gives to each shard, given what both halves give, is
    one draw with a generator named by the half's place, so all partitions see the same draws and each works out its own
    row by itself. Shard sizes differ by one at most.
    """
    rows = int(before[-1])
    left = [rows // shards + (j < rows % shards) for j in range(shards)]
    lo, hi = 0, len(before) - 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.Philox(key=[seed, lo << 32 | hi]))
        need, rest, taken = int(before[mid] - before[lo]), sum(left), []
        for n in left:
            rest -= n
            taken.append(_hypergeometric(rng, n, rest, need))
            need -= taken[-1]
        if partition < mid:
            hi, left = mid, taken
        else:
            lo, left = mid, [n - t for n, t in zip(left, taken, strict=True)]
    return np.array(left, np.int64)


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """All rows of the matrix for counts[p] rows in partition p."""
    before = np.r_[0, np.cumsum(np.array(counts, np.int64))]
    return np.array([matrix_row(before, p, shards, seed) for p in range(len(counts))]).reshape(len(counts), shards)


def _matrix_rows(before: np.ndarray, shards: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.cumsum(matrix_row(before, p, shards, seed)).tolist() for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int64()))], ["from", "upto"])

    return run


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """An exact draw; beyond numpy's range by inversion outwards from the mode."""
    if not draws or not good:
        return 0
    if not bad:
        return draws
    if max(good, bad) < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    lo, hi = max(0, draws - bad), min(draws, good)
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    up = down = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u, i, j = rng.random() - up, mode, mode
    while u > 0 and (i > lo or j < hi):
        if j < hi:
            up *= (good - j) * (draws - j) / ((j + 1) * (bad - draws + j + 1))
            j += 1
            u -= up
            if u <= 0:
                return j
        if i > lo:
            down *= i * (bad - draws + i) / ((good - i + 1) * (draws - i + 1))
            i -= 1
            u -= down
            if u <= 0:
                return i
    return mode


def shuffle_into_shards(rows: DataFrame, identity: list[str], shards: int = 24, seed: int = 7, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """`rows` with `shard` (0 to shards-1) and `slot` (gapless from 0 in each shard): one uniform random permutation.

    Rows are put into logical partitions by hash, and a communication matrix fixes how many rows of each go to each
    shard; each partition's row of it is drawn in a task of its own, from the partitions' counts, MOST_PARTITIONS numbers
    at most. Every partition permutes its rows (order of a seeded hash), deals them out by the matrix, and after the
    exchange every shard is permuted again, in parts: a part is a range of a second hash, and the counts of the
    bounded table (shard, part) give where its slots start, so no shard needs to fit one task.

    `identity` names the columns that tell rows apart; rows equal in all of them are interchangeable. All columns of
    `rows` pass through, whatever their names, but that the result's shard and slot stand in place of columns so called.
    Nulls in any column are values like others. Counts of shards differ by one at most, however the ids, texts or
    sources are distributed; an empty table gives an empty table. The same rows and seed give the same result under any
    partitioning.
    """
    spark = rows.sparkSession
    keys = [f"k{i}" for i in range(len(identity))]
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    mark = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), *keys)
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    packed = rows.select(F.struct(*map(quoted, kept)).alias("row"), *[quoted(c).alias(k) for c, k in zip(identity, keys, strict=True)])
    n = packed.count()
    logical = max(1, min(MOST_PARTITIONS, -(-n // rows_per_partition)))
    dealt = packed.withColumn("from", F.pmod(mark("partition"), F.lit(logical)))
    counts = np.zeros(logical + 1, np.int64)
    for p, c in dealt.groupBy("from").agg(F.count(F.lit(1))).collect():  # a number for each partition
        counts[p + 1] = c
    tasks = min(logical, max(1, spark.sparkContext.defaultParallelism))
    upto = spark.range(0, logical, 1, tasks).mapInArrow(_matrix_rows(np.cumsum(counts), shards, seed), "from long, upto array<long>")
    local = dealt.withColumn("at", F.row_number().over(Window.partitionBy("from").orderBy(mark("local"), *keys)) - 1)
    sent = local.join(upto, "from").withColumn("shard", F.size(F.filter("upto", lambda x: x <= F.col("at"))).cast("int"))
    sent = staged(sent.withColumn("mark", mark("shard")).withColumn("part", F.pmod(F.shiftrightunsigned("mark", 40), F.lit(PARTS))).drop("from", "at", "upto"), "shards")
    sizes = sent.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("mark", *keys)) - 1
    out = sent.withColumn("within", within).join(starts, ["shard", "part"])
    return out.select("row.*", "shard", (F.col("within") + F.col("start")).cast("long").alias("slot"))
