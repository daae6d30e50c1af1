"""Connected components of a link table, in rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labelpool.llm.batches import checkpointed, release


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is
    its smallest node. Repeated, reversed and self links are allowed.

    Alternating rounds tie each node's larger neighbours, then its smaller ones,
    to the smallest of them, until nothing changes. Each round is checkpointed
    in the shared folder. A node with many links is only ever aggregated to a
    minimum, or joined by its key, which AQE splits.
    """
    both = links.filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    edges, before = checkpointed(both), None
    while True:
        # every node's larger neighbours go to the least node around it
        around = edges.select(F.col("lo").alias("node"), F.col("hi").alias("next")).union(
            edges.select(F.col("hi").alias("node"), F.col("lo").alias("next")))
        least = around.groupBy("node").agg(F.least(F.min("next"), F.first("node")).alias("root"))
        large = around.filter("next > node").join(least, "node").select(F.col("next").alias("hi"), F.col("root").alias("lo")).distinct()
        # every node and its smaller neighbours go to the least of those
        small = large.groupBy("hi").agg(F.min("lo").alias("root"))
        tied = large.join(small, "hi").select(F.explode(F.array(
            F.struct(F.col("hi").alias("hi"), F.col("root").alias("lo")),
            F.struct(F.col("lo").alias("hi"), F.col("root").alias("lo")))).alias("e")).select("e.hi", "e.lo").filter("hi <> lo").distinct()
        new = checkpointed(tied)
        now = new.select(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        edges = new
        del around, least, large, small, tied, new
        release(links.sparkSession)   # the round's shuffles and the last round's checkpoint
        if now == before:
            break
        before = now
    members = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return members.union(roots)
