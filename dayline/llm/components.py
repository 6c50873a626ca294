"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayline.llm.common import staged


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every id that has a link to another; component is the smallest id reachable.

    `edges`: two long columns, in any direction, repeats and loops allowed, nulls ignored. Each round is two
    aggregations and two joins on ids; stars form in O(log n) rounds. Nothing but one answer a round reaches
    the driver. An empty table gives an empty table.
    """
    u, v = edges.columns[:2]
    e = edges.where(F.col(u) != F.col(v)).select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).distinct()
    e = staged(e, name)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = staged(near.unionByName(low.withColumnRenamed("m", "b")).where("a != b").distinct(), name)
        # done when the links form stars: no vertex has two centres, or is a leaf and a centre
        roles = e.select(F.col("a").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(e.select(F.col("b").alias("x"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
        if roles.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf > 1 or leaf + centre > 1").isEmpty():
            break
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
