"""Groups that links connect, by contraction of stars: rounds of grouped minima and joins, no group of links in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dropped, stored

#: Parts that a node's links are dealt to.
PARTS = 16


def _contracted(links: DataFrame, upwards: bool) -> DataFrame:
    """Every node tells the smallest node that it knows to the others: upwards to those above it, else to those below and itself.

    What a node knows is summed up by parts, and its smallest goes back to each part, so that a hub's links stay spread."""
    both = links.unionByName(links.select("space", F.col("v").alias("u"), F.col("u").alias("v"))) if upwards else links
    dealt = both.withColumn("part", F.pmod(F.hash("v"), F.lit(PARTS)))
    parts = dealt.groupBy("space", "u", "part").agg(F.min("v").alias("low"))
    least = parts.groupBy("space", "u").agg(F.least("u", F.min("low")).alias("low"), F.collect_set("part").alias("parts"))
    told = dealt.join(least.select("space", "u", "low", F.explode("parts").alias("part")), ["space", "u", "part"])
    if upwards:
        out = told.where("v > u").select("space", F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = told.select("space", F.col("v").alias("u"), F.col("low").alias("v")).unionByName(least.select("space", "u", F.col("low").alias("v")))
    return out.where("u <> v").distinct()


def connected(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """space, node and root (the smallest node that it reaches) of every node of links (space, u, v: longs that count within their space).

    Each round is stored and the one before it deleted; it ends when a round changes nothing."""
    pairs = links.where("u <> v").select("space", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = stored(pairs, "links"), None
    for _ in range(most_rounds):
        sums = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("space", "u", "v").cast("decimal(38,0)"))).first())
        if sums == before or not sums[0]:
            low = now.select("space", F.col("u").alias("node"), F.col("v").alias("root"))
            return low.unionByName(now.select("space", F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last, before = now, sums
        now = stored(_contracted(_contracted(now, True), False), "links")
        dropped(last)
    raise RuntimeError("links did not settle")
