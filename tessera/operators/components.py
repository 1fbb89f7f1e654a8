"""Connected components of an edge table by star contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.staging import drop, stage


def min_labels(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: long); label is the smallest node of its component.

    Rounds of large-star and small-star: each links a node's neighbours to the smallest of them, so edges never grow in
    number and hubs only meet in aggregates that combine before their shuffle. Each round is written to the shared
    folder; the loop ends when a round changes nothing. An empty edge table gives no rows; loops and repeats are
    ignored."""
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, now = now, stage(moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        drop(old)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
