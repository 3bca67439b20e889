"""Connected components by alternating large and small stars over an edge table; no node's neighbours are ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.runtime import materialize, release


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b) other than a root: root is the smallest node that can be reached.

    Every step is a minimum for each node, which partial aggregation combines before the shuffle, and a join, whose hot
    side adaptive execution splits. The number of steps grows with the logarithm of the longest path. Null ends and
    loops are ignored.
    """
    clean = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = materialize(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        kept = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = materialize(kept.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        release(now, large)
        now, before, state = small, state, _state(small)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
