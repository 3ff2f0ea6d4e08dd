"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges(a, b), both long: root is the smallest node of its component.

    Each round points every node at its smallest neighbour, follows pointers two steps and contracts the edges, so the
    number of edges falls by a constant factor or more. Minima combine before the shuffle, so a node with very many
    edges is no hot group; each round is a written table, so a lost executor costs that round at most.
    """
    live = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live, labels = staged(live, "cc-edges"), None
    while True:
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p"))
        step = staged(point, "cc-points")
        up = step.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        step = staged(step.join(up, "p", "left").select(F.col("a").alias("u"), F.coalesce("pp", "p").alias("p")), "cc-steps")
        if labels is None:
            labels = step.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            labels = labels.join(step, labels["root"] == step["u"], "left").select("node", F.coalesce("p", "root").alias("root"))
        labels = staged(labels, "cc-labels")
        a, b = (step.select(F.col("u").alias(x), F.col("p").alias(f"p{x}")) for x in ("a", "b"))
        live = live.join(a, "a").join(b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        live = staged(live, "cc-edges")
        if live.isEmpty():
            return labels
