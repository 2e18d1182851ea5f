"""Connected components of an undirected graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import staged


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(u, v)``; a component is named by its least node.

    Each round takes the least name among the neighbours and then the name's own name, so chains
    shorten by more than half a round. Rounds are staged in the shared folder; only the number of
    changed names reaches the driver.
    """
    both = staged(links.select("u", "v").union(links.select("v", "u")).filter("u <> v").distinct(), "links")
    names = staged(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("component")), "names")
    while True:
        near = (both.join(names.select(F.col("node").alias("v"), "component"), "v")
                .groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near")))
        met = names.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        after = met.select(F.col("node").alias("component"), F.col("component").alias("further"))
        names = staged(met.join(after, "component", "left").select(
            "node", "was", F.coalesce(F.least("component", "further"), "component").alias("component")), "names")
        changed = names.filter("component <> was").limit(1).count()
        names = names.select("node", "component")
        if not changed:
            return names


def joined_components(named: DataFrame, links: DataFrame) -> DataFrame:
    """``named`` after further ``links(u, v)``: only the graph between the components is walked."""
    ends = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
    alone = ends.join(named, "node", "left_anti").select("node", F.col("node").alias("component"))
    every = staged(named.select("node", "component").union(alone), "named")
    end = lambda x: every.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    between = links.join(end("u"), "u").join(end("v"), "v").select(F.col("of_u").alias("u"), F.col("of_v").alias("v")).filter("u <> v").distinct()
    above = components(between).select(F.col("node").alias("component"), F.col("component").alias("above"))
    return every.join(above, "component", "left").select("node", F.coalesce("above", "component").alias("component"))
