"""Connected components of an edge list, as a loop of Spark joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, label) for the columns a and b of `edges`: nodes share a label, the least
    node of their component, exactly if a path joins them.

    Each round takes the least label among a node's neighbours and then jumps to the label of
    that label, so the number of rounds grows with the logarithm of the longest path. A node
    with very many neighbours is met by a partial aggregation before the shuffle and by the
    adaptive split of skewed joins. Every round ends in a checkpoint. Self loops and repeated
    edges change nothing; null ends are ignored; no edges give no rows.
    """
    links = edges.select("a", "b").where("a is not null and b is not null")
    links = cut(links.union(links.select("b", "a")).distinct())
    labels = cut(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")))
    while True:
        near = links.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("down"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("jump"))
        fresh = cut(
            step.join(jump, F.col("down") == F.col("via"), "left").select(
                "node", F.least("down", F.coalesce("jump", "down")).alias("label"), F.col("label").alias("was")
            )
        )
        changed = fresh.where("label <> was").limit(1).count()
        labels = fresh.select("node", "label")
        if not changed:
            return labels
