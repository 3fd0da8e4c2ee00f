"""Connected components of an edge table by large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .common import spread_join


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of the edges (a, b): label is the least node of its component.

    Rounds go on until every component is a star around its least node. Each hangs a node's greater neighbours on the least
    one, then its smaller neighbours likewise; that takes O(log^2 n) rounds. Minima are combined before the shuffle and the
    joins back deal the neighbours of a hub over several tasks, so a hub is never gathered.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")

    def seen(edges: DataFrame):
        """Ends of edges, the most of them at a node, and how many nodes are not in place: the least of a star, or one of
        its tips, which has no neighbour but a smaller one."""
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        each = both.groupBy("u").agg(F.count("*").alias("n"), F.count_if(F.col("v") < F.col("u")).alias("k"))
        return each.agg(F.sum("n"), F.max("n"), F.count_if((F.col("k") > 0) & (F.col("n") > 1))).first()

    for _ in range(most_rounds):
        total, most, astray = seen(now)
        if not astray:
            break
        load = (total or 0, most or 0)
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n_")).select("u", F.least("u", "m").alias("m"), "n_")
        large = spread_join(both.where("v > u"), least, ["u"], F.col("v"), load=load).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n_"))
        small = spread_join(large, least, ["u"], F.col("v"), load=load).select("u", "v", "m")
        hung = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = materialize(hung.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
