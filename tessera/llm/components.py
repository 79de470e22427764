"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, save


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the ends of edges (a, b): comp is the component's smallest node.

    Each round points every node to the smallest of itself and its neighbours, follows pointers four steps, and goes on
    with the edges between the nodes pointed to, which are far fewer. Every round is a table in the shared folder.
    Nothing but the word that edges are left comes to the driver."""
    left = save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels: DataFrame | None = None
    while True:
        both = left.union(left.select("b", "a"))
        first = save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "pointers")
        on = first.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        point = first
        for _ in range(3):
            point = point.join(on, "comp").select("node", F.col("to").alias("comp"))
        point = save(point, "pointers")
        to = point.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        old = [first, left] if labels is None else [first, left, labels, point]
        labels = point if labels is None else save(labels.join(to, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        a, b = (point.select(F.col("node").alias(c), F.col("comp").alias(f"of_{c}")) for c in "ab")
        ends = F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")
        left = save(left.join(a, "a").join(b, "b").where("of_a <> of_b").select(*ends).distinct(), "edges")
        drop(*old)
        if left.isEmpty():
            drop(left)
            return labels
