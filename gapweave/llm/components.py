"""Connected components by alternating large and small stars, one written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.plans.storage import materialize


def _downward(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` to ``(node, component)``: the smallest node reachable. Nodes without an edge to another node do not appear.

    Each round every node hands its larger, then its smaller neighbours to its smallest one, with a grouped minimum (combined before
    the shuffle) and a join, so a hub with any share of the edges is never gathered; components end as stars after about
    log(diameter) rounds. Only a count and a checksum reach the driver.
    """
    now = materialize(_downward(edges), "stars")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written minima stand beside the edges as tables of their own, so the join may be broadcast or its skewed parts split
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars-least")
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "stars-large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "stars-low")
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(_downward(moved.unionByName(low.withColumnRenamed("m", "v"))), "stars")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
