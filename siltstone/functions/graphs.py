"""Connected components of a table of links, by rounds of smallest labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import written


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for every node of a link the smallest node that it is linked with, over
    any number of links. Each round halves long chains (a label's own label is taken), and is
    written out, so that plans stay short; the driver sees only whether a round changed anything.
    """
    both = written(links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct(), "links")
    labels = written(both.groupBy("x").agg(F.least(F.min("x"), F.min("y")).alias("c")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("c").alias("m"))
        own = labels.select(F.col("x").alias("c"), F.col("c").alias("cc"))
        step = labels.join(near, "x").join(own, "c", "left").select("x", F.col("c").alias("old"), F.least("c", "m", "cc").alias("c"))
        step = written(step, "labels")
        labels = step.select("x", "c")
        if step.where("old != c").isEmpty():
            return labels.select(F.col("x").alias("node"), F.col("c").alias("component"))
