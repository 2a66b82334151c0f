"""Connected components of a table of links, by the smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(links: DataFrame) -> DataFrame:
    """The nodes of links (a, b: long) with comp, the smallest node that they reach: node, comp.

    Each round every node takes the smallest label among its neighbours' and then its label's label. Minima are
    combined before they are shuffled, and no node's neighbours are gathered. Links of a node with itself, repeated and
    reversed ones may occur; an empty table gives no rows.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).dropDuplicates(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("heard"))
        told = labels.join(heard, "node").select("node", F.col("comp").alias("was"), F.least("comp", "heard").alias("comp"))
        of_label = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = written(told.join(of_label, "comp").select("node", "was", F.least("comp", "next").alias("comp")), "labels")
        dropped(labels)
        labels = new.select("node", "comp")
        if new.where("was <> comp").isEmpty():
            dropped(both)
            return labels
