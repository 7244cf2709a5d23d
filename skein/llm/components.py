"""Connected components by alternating large-star and small-star steps, on DataFrames.

A step takes each node's least neighbour (pre-aggregated before its shuffle) and joins it back, so a hub's
neighbours never meet in one task as a list. Each round is written to the shared folder; its edges are counted
and summed by hash, and rounds end when nothing changes.

Links of a node with itself, repeated links and links given in both directions change nothing; links with a null end
are left out; no links give no components: nodes without one are the caller's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (longs) -> node, root: the least node that each linked node reaches."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        # (v, m) for the further neighbours, (u, m) for the node itself
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u <> v").distinct(), "small-star")
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
