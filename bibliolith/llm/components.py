"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def _with_least(edges: DataFrame, hub: int) -> DataFrame:
    """``edges`` (``u``, ``v``) with ``m``, the least ``v`` of their ``u``.

    Nodes of more than ``hub`` edges are fewer than edges / ``hub``, so they are broadcast; their own edges are spread
    over the partitions of the join by ``v``, where they would all meet in one task by ``u``.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    hubs = least.where(F.col("n") > hub).select("u", F.col("m").alias("hub_m"))
    none = F.lit(0).cast("long")
    spread = F.when(F.col("hub_m").isNotNull(), F.xxhash64("v")).otherwise(none)
    dealt = edges.join(F.broadcast(hubs), "u", "left").withColumn("spread", spread)
    rest = least.where(F.col("n") <= hub).select("u", none.alias("spread"), "m")
    return dealt.join(rest, ["u", "spread"], "left").select("u", "v", F.coalesce("hub_m", "m").alias("m"))


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60, most_hubs: int = 4096, least_hub: int = 65_536) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``a``, ``b``); a component is named by its least node.

    Each round is a pair of aggregations and joins over the edges; rounds grow with the logarithm of the
    longest path, and every round is a written table.  A node of any degree is aggregated, never collected,
    and its edges are dealt over all tasks: nodes of over ``least_hub`` edges, and of over a share of
    1 / ``most_hubs`` of them all, are broadcast (at most twice ``most_hubs`` rows).
    """
    current = scratch.write(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    summary = F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))
    mark = current.agg(*summary).first()
    for _ in range(max_rounds):
        hub = max(least_hub, mark[0] // most_hubs)
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, hub).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = scratch.write(large.distinct())
        small = _with_least(large, hub).select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        following = scratch.write(small.distinct())
        now = following.agg(*summary).first()
        scratch.drop(current, large)
        current = following
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
