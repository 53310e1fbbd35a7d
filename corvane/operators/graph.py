"""Identity components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, label: the smallest node that can be reached.

    Each round takes the least label among neighbours and then follows the label's
    own label, so long chains shrink by halves; rounds are written to the shared
    folder, and the driver learns only whether a label has changed.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a IS NOT NULL AND b IS NOT NULL")
    both = written(both.distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("heard"))
        step = labels.join(heard, labels["node"] == heard["a"], "left").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        up = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        step = step.join(up, step["label"] == up["via"], "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        step = written(step, "labels")
        labels = step.select("node", "label")
        if step.filter("label <> old").isEmpty():
            return labels


def identities(nodes: DataFrame, edges: DataFrame, held: DataFrame) -> DataFrame:
    """node, identity: components of confirmed edges; a component keeps the least identity that any member held.

    nodes (node), edges (a, b), held (node, identity).  Nodes without an edge and without a held
    identity have none; a new component is named by its least node.
    """
    labels = components(edges)
    known = labels.join(held, "node", "left").groupBy("label").agg(F.min("identity").alias("kept"))
    placed = labels.join(known, "label").select("node", F.coalesce(F.col("kept"), F.concat(F.lit("identity:"), F.col("label").cast("string"))).alias("identity"))
    return nodes.join(placed, "node", "inner")
