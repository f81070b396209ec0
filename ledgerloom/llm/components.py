"""Connected components by alternating star contraction, as joins and group-bys over the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the links (a, b; longs): the smallest node reachable.

    Each round first hangs every node's larger neighbours on its smallest neighbour, then its smaller ones; the links
    shrink to stars in about log n rounds. A hub's links meet as one partially aggregated minimum; minima are written
    first, so the join that gives them back has plain shuffles on both sides and Spark can split a hub's links over
    tasks. Every step is written to the shared folder. Links with a null end
    and loops are left out; repeated links count once; no links give no rows.
    """
    edges = materialize(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    for _ in range(most_rounds):
        # large star: both directions; larger neighbours (and the node) go to the smallest of the neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "w"), "least")
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "links")
        # small star: smaller neighbours and the node itself go to the smallest
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w"), "least")
        tied = large.join(least, F.col("u") == F.col("w"))
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(tied.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialize(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return materialize(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
