"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, drop, materialize


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, kept: Written | None = None) -> DataFrame:
    """The component of each vertex with an edge, as (id, component); component is its least vertex.

    edges: (a, b) of two long ids. No component is ever gathered in one task:
    each step takes a minimum per vertex and joins it back, so a hub is split by
    the partial aggregation and by the skew join. It ends when the edges form
    stars, after about log2 of the longest path's rounds.
    """
    spark = edges.sparkSession
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), kept)
    mark = None
    mine: Written = Written()
    while True:
        # large star: each vertex ties its larger neighbours to the least of its neighbours and itself
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: each vertex ties its smaller neighbours and itself to the least of them
        least = _least(large)
        tied = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = tied.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        made: Written = Written()
        now = materialize(step, made)
        new = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop(spark, mine)
        mine = made
        if new == mark:
            break
        mark = new
    if kept is not None:
        kept.extend(mine)
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component").distinct())
