"""Connected components of a link table by minimum labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of longs -> ``(node, label)``: each linked node with the
    smallest node that it reaches.

    Each round takes the smallest label of the neighbours and then the label of
    that label, so the rounds grow with the logarithm of the longest path. Every
    half round is a written table, from which both sides of the next join are
    read, so that a hub with very many neighbours is split by the skew join.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = written(both.join(labels.withColumnRenamed("node", "b"), "b")
                       .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        closer = written(labels.join(near, "node").select(
            "node", F.col("label").alias("was"), F.least("label", "near").alias("label")))
        hop = closer.select(F.col("node").alias("label"), F.col("label").alias("next"))
        nxt = written(closer.join(hop, "label", "left").select(
            "node", "was", F.coalesce("next", "label").alias("label")))
        labels = nxt.select("node", "label")
        if nxt.where("was <> label").isEmpty():
            return labels
