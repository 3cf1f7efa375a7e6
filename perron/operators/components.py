"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perron.staging import discard, stage


def connected_components(edges: DataFrame, smallest: bool = True) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``: the smallest node it can reach.

    Each round maps every node to the first of itself and its neighbours in the order of a hash, and
    edges to their images; loops and repeats fall away. That keeps what is connected connected, a
    star is gone after two rounds, and as the order has nothing to do with how nodes are named, a
    chain shortens by a constant factor each round. Every round is written to the shared folder; only
    whether an edge is left reaches the driver. Nodes may have any orderable type. With ``smallest``
    False a component is named by any of its nodes, which saves the last aggregation.
    """
    left = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = stage(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    left = left.where("a <> b")
    while left.limit(1).count():
        ends = left.select(F.explode(F.expr("array(struct(a AS x, b AS y), struct(b AS x, a AS y), struct(a AS x, a AS y), struct(b AS x, b AS y))")).alias("e")).select("e.*")
        image = stage(ends.groupBy("x").agg(F.min(F.struct(F.xxhash64("y").alias("h"), "y")).alias("m")).select(F.col("x").alias("component"), F.col("m.y").alias("image")), "images")
        to = lambda end: image.select(F.col("component").alias(end), F.col("image").alias(f"_{end}"))  # noqa: E731, B023
        mapped = left.join(to("a"), "a").join(to("b"), "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        after = stage(mapped.where("a <> b").distinct(), "edges")
        renamed = stage(labels.join(image, "component", "left").select("node", F.coalesce("image", "component").alias("component")), "labels")
        discard(image, labels)
        left, labels = after, renamed
    if not smallest:
        return labels
    named = stage(labels.groupBy("component").agg(F.min("node").alias("least")), "names")
    return labels.join(named, "component").select("node", F.col("least").alias("component"))
