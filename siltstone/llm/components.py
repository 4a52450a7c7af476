"""Connected components of a table of edges by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.scratch import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: bigint); the component is its smallest node.

    Self-loops and repeated edges change nothing; no edges give no rows. Each round writes
    its tables, so lineage stays short, and the join of a node with many neighbours reads
    two tables, which the adaptive join can split.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low2 = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        moved = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = materialize(moved.union(low2.select("u", F.col("m").alias("v"))).distinct(), "small")
        discard(e, low, large, low2)
        e = small
        # done once every node has one edge, and that to a node without an edge of its own
        parents = e.select(F.col("v").alias("u")).distinct()
        if e.groupBy("u").count().where("count > 1").union(e.join(parents, "u", "left_semi").select("u", F.lit(0).cast("long").alias("count"))).isEmpty():
            break
    return materialize(e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct()), "components")
