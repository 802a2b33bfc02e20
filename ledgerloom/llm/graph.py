"""Connected components of links, as iterated joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, stored


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (v, component): the smallest vertex reachable, for every vertex that has a link.

    Each round takes the smallest label among a vertex and its neighbours, then the label of that
    label, so labels reach over twice the distance each time. Every round is written to the shared
    folder: lineage stays short and a lost executor repeats one round at most. Only sums reach the driver.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    total = lambda x: x.agg(F.sum(F.col("component").cast("decimal(38,0)"))).head()[0]
    seen = total(labels)
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "component"), "b").groupBy(F.col("a").alias("v")).agg(F.min("component").alias("other"))
        least = labels.join(near, "v").select("v", F.least("component", "other").alias("component"))
        roots = labels.select(F.col("v").alias("component"), F.col("component").alias("root"))
        new = stored(least.join(roots, "component").select("v", F.least("component", "root").alias("component")), "labels")
        drop(labels)
        labels, now = new, total(new)
        if now == seen:
            drop(both)
            return labels
        seen = now
