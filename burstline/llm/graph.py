"""Connected components of links, without bringing them to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b): the smallest node that it can reach.

    Minimum labels travel along the links and are shortened by the labels' own labels, so that
    the rounds follow the logarithm of a component's diameter.  Each round is a written table.
    A node with many links is counted before it is shuffled.
    """
    links = links.where("a <> b")
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.least("component", "near").alias("next"), F.col("component").alias("was"))
        old = labels.select(F.col("node").alias("at"), F.col("component").alias("further"))
        new = written(step.join(old, step.next == old["at"]).select("node", F.least("next", "further").alias("component"), "was"), "labels")
        labels = new.select("node", "component")
        if new.where("component <> was").isEmpty():
            return labels
