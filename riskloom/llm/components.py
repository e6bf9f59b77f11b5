"""Connected components of an edge table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """node, label: for each node of ``edges`` (a, b) the least node of its component.

    Labels travel along edges, then each node takes its label's label; both are
    aggregates with partial sums, so a node with very many edges is no hot group.
    The tables of each round are written, never collected.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc_edges")
    label = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "cc_label")
    while True:
        near = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("mid"))
        step = materialise(step, "cc_step")
        hop = step.select(F.col("node").alias("mid"), F.col("mid").alias("next"))
        new = materialise(step.join(hop, "mid").select("node", "was", F.least("mid", "next").alias("label")), "cc_label")
        changed = new.where("label != was").limit(1).count()
        label = new.select("node", "label")
        if not changed:
            return label
