"""Connected components by contraction: tables only, so no list of links or labels is ever in one place.

Defined cases: links with themselves and repeated ones change nothing; links with a null end are left out; a table
without links gives no rows; other columns are ignored. A node with many links, or a component of many nodes, is dealt to
several tasks in each join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, spread_join, stored


def components(links: DataFrame) -> DataFrame:
    """Of links (a, b): node and comp, the smallest node that it reaches, for every node that has a link.

    Each round hooks every node to its smallest neighbour, follows two hooks more, and contracts the links;
    each node that isn't a local minimum goes, so the number of rounds grows with the logarithm of the nodes.
    """
    edges = stored(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        hook = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "hook")
        for _ in range(2):
            up = hook.select(F.col("node").alias("comp"), F.col("comp").alias("c"))
            hook = spread_join(hook, up, "comp", "node", "left").select("node", F.coalesce("c", "comp").alias("comp"))
        hook = stored(hook, "hooks")
        to = lambda c: hook.select(F.col("node").alias(c), F.col("comp").alias(f"to_{c}"))
        moved = spread_join(spread_join(edges, to("a"), "a", "b"), to("b"), "b", "a")
        moved = moved.filter("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        moved = stored(moved, "links")
        drop_stored(edges)
        edges = moved
        if labels is None:
            labels = hook
        else:
            up = hook.select(F.col("node").alias("comp"), F.col("comp").alias("c"))
            new = stored(spread_join(labels, up, "comp", "node", "left").select("node", F.coalesce("c", "comp").alias("comp")), "labels")
            drop_stored(labels, hook)
            labels = new
    return labels
