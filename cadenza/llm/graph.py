"""Connected components by smallest labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import keep


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges``: ``a, b`` (long).  Returns ``node, label``: the smallest node of the
    component, for every node that has an edge.

    A round takes the smallest label among a node's neighbours (combined before the
    shuffle) and then the label of that label, so long chains shrink by doubling.
    Each round is written, which cuts the lineage; only the number of changes
    reaches the driver."""
    e = edges.select("a", "b").where("a <> b").distinct()
    e = keep(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))), "graph-edges")
    lab = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    lab = keep(lab, "graph-labels")
    for _ in range(max_rounds):
        near = (e.join(lab, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m")))
        step = keep(lab.join(near, F.col("node") == F.col("a"), "left")
                    .select("node", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label")),
                    "graph-step")
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        lab = keep(step.join(jump, "label").select("node", "old", F.least("label", "up").alias("label")), "graph-labels")
        if lab.where("old <> label").isEmpty():
            return lab.select("node", "label")
        lab = lab.select("node", "label")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
