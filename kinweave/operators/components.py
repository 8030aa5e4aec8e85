"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import checkpoint


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """(node, label): the least node of each node's component, for nodes that have an edge.

    rounds: go so far only; nodes of one label are then connected, but a component may still have several labels.

    Rounds of least-neighbour labels and pointer jumping, O(log of the diameter) in practice. Each round is two joins
    on node with pre-aggregated minima, so a node with very many edges is split like any skewed join; a round's
    labels are checkpointed and survive the loss of an executor.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = pairs.union(pairs.select("y", "x")).distinct()
    if rounds is not None:
        labels = both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("l")).select("node", F.least("node", "l").alias("label"))
        for _ in range(rounds - 1):
            near = both.join(labels, F.col("y") == F.col("node")).groupBy(F.col("x").alias("n")).agg(F.min("label").alias("l"))
            labels = labels.join(near, F.col("node") == F.col("n")).select("node", F.least("label", "l").alias("label"))
        return labels
    both = checkpoint(both)
    labels = checkpoint(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("l")).select("node", F.least("node", "l").alias("label")))
    while True:
        near = both.join(labels, F.col("y") == F.col("node")).groupBy(F.col("x").alias("n")).agg(F.min("label").alias("l"))
        spread = labels.join(near, F.col("node") == F.col("n")).select("node", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        spread = checkpoint(spread)
        heads = spread.select(F.col("node").alias("h"), F.col("label").alias("to"))
        jumped = checkpoint(spread.join(heads, F.col("label") == F.col("h"), "left").select("node", "old", F.coalesce("to", "label").alias("label")))
        labels = jumped.select("node", "label")
        if jumped.where("old <> label").isEmpty():
            return labels
