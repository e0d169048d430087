"""Connected components of links held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_written, written


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that can be reached, for every node that has a link.

    links: columns a and b, in any order, repeated or not. Each round takes the smallest label among a
    node's neighbours and then the label of that label, so that the rounds grow with the logarithm of
    the longest path. Labels go through tables in the shared folder, never through the driver; a round's
    tables are deleted after the next.
    """
    both = links.filter("a <> b").select("a", "b")
    both = written(both.union(both.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    before = None
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        hooked = written(labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("label")), "labels")
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("root"))
        last, labels = labels, written(hooked.join(jump, "label").select("node", F.col("root").alias("label")), "labels")
        delete_written(last)
        delete_written(hooked)
        # a sum over all labels falls in every round that changes one
        total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if total == before:
            delete_written(both)
            return labels.withColumnRenamed("label", "component")
        before = total
