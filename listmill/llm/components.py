"""Connected components of a table of links, by smallest label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listmill.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of (a, b) links; component is the smallest node that can be reached.

    Each round takes the smallest label among the neighbours and then the label of that label, until nothing
    changes.  Every round is written, so a node with very many links is split by the skew join, and lineage ends.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        least = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        hooked = written(labels.join(least, labels["node"] == least["a"]).select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("component")), "hooked")
        above = hooked.select(F.col("node").alias("up"), F.col("component").alias("top"))
        labels = written(hooked.join(above, F.col("component") == F.col("up")).select(
            "node", "old", F.least("top", "component").alias("component")), "labels")
        if labels.filter("old <> component").isEmpty():
            return labels.select("node", "component")
        labels = labels.drop("old")
