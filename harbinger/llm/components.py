"""Connected components by alternating large and small stars; every round is a written table, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbinger.llm import common


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, component): each linked node and the smallest node it can be reached from.

    Loops and repeats are ignored, nulls too; no links give no rows. A round takes the minimum of each node's
    neighbours (a partial sum before any shuffle) and joins it back, so a node with very many links is a skewed
    join and no single group.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = common.table(now, "links")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        before, now = now, common.table(small.distinct(), "stars")
        common.discard(before)
        got = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(got) == mark:
            break
        mark = tuple(got)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
