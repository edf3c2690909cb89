"""Connected components by contraction: the smallest id reachable from each id that has an edge.

Every round points each id to its smallest neighbour, jumps pointers until they rest, and contracts the edges to the
roots, which shrinks the graph geometrically. Every step is an aggregation or a join on a table in the shared folder;
nothing but counts comes to the driver, and a hub with many edges is combined before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.plans.runtime import materialize


def resting(parent: DataFrame) -> DataFrame:
    """Pointer jumping: (id, root) for which every root points to itself."""
    while True:
        jumped = materialize(
            parent.alias("x").join(parent.alias("y").hint("merge"), F.col("x.root") == F.col("y.id")).select("x.id", F.col("y.root").alias("root"), (F.col("x.root") != F.col("y.root")).alias("moved")), "jump"
        )
        parent = jumped.select("id", "root")
        if jumped.where("moved").isEmpty():
            return parent


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) → (id, component); directions, repeated edges and loops do not matter."""
    clean = lambda df: df.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, found = materialize(clean(edges), "edges"), None
    while True:
        if left.isEmpty():
            return found if found is not None else left.select(F.col("a").alias("id"), F.col("b").alias("component"))
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = resting(materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("root")), "parent"))
        at = lambda c: parent.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root")).hint("merge")
        left = materialize(clean(left.join(at("a"), "a").join(at("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))), "edges")
        step = parent.select(F.col("id").alias("component"), "root").hint("merge")
        if found is None:
            found = parent.select("id", F.col("root").alias("component"))
        else:
            found = materialize(found.join(step, "component", "left").select("id", F.coalesce("root", "component").alias("component")), "found")
