"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickflow.llm.common import keep


def component_labels(links: DataFrame) -> DataFrame:
    """``node``, ``label`` (the least node of its component) for every node of ``links`` (a, b).

    Every round takes the least label of each node's neighbours and then the
    label of that label, so a chain of n links needs about log n rounds. Each
    round is written, which cuts the lineage; a node with very many links is
    pre-aggregated before it is shuffled.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a != b")
    # every node is its own neighbour too, so one grouping gives the new label and the old one
    both = keep(both.union(both.select("a", F.col("a").alias("b"))).distinct())
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
    own = F.max(F.when(F.col("a") == F.col("b"), F.col("label")))
    while True:
        lower = keep(both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("lower"), own.alias("old"))
                     .withColumnRenamed("a", "node"))
        if not lower.where("lower != old").limit(1).count():
            return labels
        further = lower.select(F.col("node").alias("via"), F.col("lower").alias("label"))
        labels = keep(lower.join(further, lower["lower"] == further["via"]).select("node", "label"))
