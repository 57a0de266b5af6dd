"""Connected components of a table of links, by hooking to smaller neighbours and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node of the component of every node of ``links`` (a, b), which are some number or text.

    Every round has three steps.  Hook: each root takes the smallest root among its neighbours
    as its parent.  Jump: parents become parents of parents until all point to roots.
    Contract: links become links between roots, equal ones and loops go.  A root with links hooks, or all
    its neighbours do, so every round merges components and links get fewer.  Smallest neighbours
    are pre-aggregated before their exchange, so a node with very many links costs one row a task there.
    """
    edges = stored(links.select("a", "b").where("a <> b").distinct())
    parents = stored(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
                     .select("node", F.col("node").alias("root")))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # A root smaller than all its neighbours stays one; the smallest node of a component always does.
        hooks = stored(both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("from"), F.least("a", "to").alias("to")))
        while True:
            ahead = hooks.select(F.col("from").alias("to"), F.col("to").alias("far"))
            jumped = stored(hooks.join(ahead, "to").select("from", "to", "far"))
            hooks = jumped.select("from", F.col("far").alias("to"))
            if jumped.where("far <> to").isEmpty():
                break
        new = hooks.select(F.col("from").alias("root"), F.col("to").alias("top"))
        parents = stored(parents.join(new, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        ends = edges.join(hooks.select(F.col("from").alias("a"), F.col("to").alias("x")), "a").join(hooks.select(F.col("from").alias("b"), F.col("to").alias("y")), "b")
        edges = stored(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct())
    return parents.select("node", F.col("root").alias("component"))
