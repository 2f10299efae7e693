"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsluice.llm.common import Scratch

ROUNDS = 100


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) of every node that has an edge; root is the component's smallest node.

    ``edges``: two columns of nodes. Loops and repeats are ignored; no edges give no
    rows. Every round is written to the shared folder, so a lost executor costs one
    round, and each node's neighbours only ever meet in minima that combine before
    they are shuffled.
    """
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    for r in range(ROUNDS):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = scratch.save(large, f"{name}-large{r}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct()
        now = scratch.save(small, f"{name}-small{r}")
        scratch.drop(f"{name}-large{r}", *([f"{name}-small{r - 1}"] if r else []))
        # done when every node has one neighbour and no neighbour has one of its own
        roles = now.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above"))
        roles = roles.union(now.select("v", F.lit(0), F.lit(1))).groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if roles.filter("below > 1 or (below = 1 and above = 1)").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
    raise ValueError(f"components did not settle in {ROUNDS} rounds")
