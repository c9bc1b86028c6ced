"""Connected components of a graph kept as an edge table; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reachable.

    Each round a node takes the smallest label around it, then the label of that
    label (pointer jumping), so paths shorten geometrically; the loop ends when no
    label changes. Joins stay equi-joins on nodes, which adaptive execution splits
    where one node has many edges. An empty edge table gives an empty result.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both, f"{label}-edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), label)
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("seen"))
        nearer = labels.join(around, F.col("node") == F.col("a")).select("node", F.col("root").alias("was"), F.least("root", "seen").alias("now"))
        jumped = nearer.join(labels.select(F.col("node").alias("n"), F.col("root").alias("r")), F.col("now") == F.col("n"))
        new = materialize(jumped.select("node", "was", F.least("now", "r").alias("root")), label)
        labels = new.select("node", "root")
        if new.where("root <> was").isEmpty():
            return labels
