"""Connected components by contraction: every node joins its least neighbour, and edges between what remains are contracted again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component, a node of the same component, for every node of edges (columns a and b, long).

    Each round at least halves the nodes that still have edges. Rounds are tables in the shared folder; only counts reach the driver.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = nodes.withColumn("component", F.col("node"))
    left = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while left.limit(1).count():
        both = left.union(left.select("b", "a"))
        least = materialize(both.groupBy(F.col("a").alias("old")).agg(F.least(F.min("b"), F.first("a")).alias("new")))
        joined = labels.join(least, labels["component"] == least["old"], "left")
        labels = materialize(joined.select("node", F.coalesce("new", "component").alias("component")))
        x = left.join(least.withColumnsRenamed({"old": "a", "new": "to_a"}), "a").join(least.withColumnsRenamed({"old": "b", "new": "to_b"}), "b")
        left = materialize(x.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    return labels
