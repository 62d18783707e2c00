"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns node, label: the smallest node of each linked node's component. Links of
    a node to itself or to null count for nothing, repeated ones once; no links, no rows.

    Every round a node takes the least label among its neighbours and its own, then the label of its
    label; each round's labels are a written table, so lineage stays short and both sides of every
    join are plain tables whose hot keys adaptive execution can split. Minima are combined before
    the shuffle. Labels never reach the driver; it sees one count a round."""
    links = cut(links.where("a <> b").select("a", "b").distinct())
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")))
    while True:
        # a neighbour's label, or one's own
        heard = both.join(labels.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "label").unionByName(labels.select("node", "label"))
        # and whoever held the old label as its root hears of the new one
        near = cut(heard.groupBy("node").agg(F.min("label").alias("label")))
        root = near.join(labels.select("node", F.col("label").alias("old")), "node").groupBy(F.col("old").alias("node")).agg(F.min("label").alias("label"))
        hooked = cut(near.unionByName(root).groupBy("node").agg(F.min("label").alias("label")))
        jumped = cut(hooked.alias("x").join(hooked.alias("y"), F.col("x.label") == F.col("y.node")).select("x.node", F.col("y.label").alias("label")))
        changed = jumped.join(labels.withColumnRenamed("label", "was"), "node").where("label <> was").limit(1).count()
        labels = jumped
        if not changed:
            return labels
