"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.operators.staging import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round. Large: every node hands its larger neighbours to its smallest one. Small: it hands over the smaller ones and itself."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("low", "u"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).union(least.select("u", F.col("low").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v of any ordered type): root is the component's smallest node.

    Every round is written to the shared folder, so a lost executor costs one round at most; links and
    components stay distributed. Rounds grow with the logarithm of the longest chain. Self-links count as
    no link; nodes without links don't appear; no links give an empty result.
    """
    now = stage(edges.select("u", "v").where("u <> v").distinct(), "cc-edges")
    state = None
    while True:
        now = stage(_star(_star(now, True), False), "cc-edges")
        r = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (r["n"], r["s"]) == state:
            break
        state = (r["n"], r["s"])
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
