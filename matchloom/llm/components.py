"""Connected components of a link table, by repeated hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) of longs to (node, component), component the least node reachable.

    Every node hooks to its least neighbour, chains are shortened until all point to a root,
    and the links between roots make the next, smaller round. Least neighbours are summed up
    before the shuffle, joins run on tables read from storage (adaptive execution can split a
    hub), and only counts come to the driver. Loops and repeated links do no harm; nodes without
    links are not in the result.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(both.where("a <> b").distinct(), "cc-links")
    found = None
    while not edges.isEmpty():
        parents = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("parent")), "cc-parents")
        while True:
            up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
            parents = materialize(parents.join(up, "parent").select("node", F.col("top").alias("parent"), (F.col("top") != F.col("parent")).alias("moved")), "cc-jump")
            if parents.where("moved").isEmpty():
                break
        parents = parents.select("node", "parent")
        if found is None:
            found = parents.select("node", F.col("parent").alias("component"))
        else:
            up = parents.select(F.col("node").alias("component"), F.col("parent").alias("top"))
            found = found.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        one = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        two = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        edges = materialize(
            edges.join(one, "a").join(two, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(),
            "cc-links",
        )
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return materialize(found, "cc-found")
