"""Connected components and minimum spanning networks of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): label is the least node that edges (a, b) reach.

    Each round every root takes the least root among its neighbours' roots (hooking), then labels are replaced by their
    labels' labels (pointer jumping), so that rounds grow with the logarithm of the longest path. Labels are written each
    round."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    now = materialize(nodes.select("node", F.col("node").alias("label")).distinct(), "labels")
    for _ in range(most_rounds):
        la, lb = now.select(F.col("node").alias("a"), F.col("label").alias("la")), now.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        seen = both.join(la, "a").join(lb, "b").where("lb < la")
        hooks = materialize(seen.groupBy(F.col("la").alias("label")).agg(F.min("lb").alias("to")), "hooks")
        if hooks.isEmpty():
            return now
        for _ in range(2):  # hooks point to smaller labels: following them cannot turn in a circle
            on = hooks.select(F.col("label").alias("to"), F.col("to").alias("next"))
            hooks = hooks.join(on, "to", "left").select("label", F.coalesce("next", "to").alias("to"))
        now = materialize(now.join(hooks, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
    raise RuntimeError(f"components not settled after {most_rounds} rounds")


def spanning_network(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, d): the union of all minimum spanning trees of pairs (a, b, d).

    One tree is grown by Borůvka's rounds, each of which at least halves the components: every component takes its least
    pair (by distance, then ends) and is hung on the component there. What each node's component was after every round,
    and the greatest distance taken on the way, is kept with the node. The greatest distance on the tree's path between
    two nodes is the greatest that either took before their components became one (King, 1997); a pair is in some minimum
    spanning tree exactly if its own is no greater. So no pair is looked at more than once a round, and rounds grow with
    the logarithm of the nodes.

    Pairs without a distance, and of a node with itself, count for nothing; of equal pairs one is told."""
    pairs = materialize(pairs.where("d is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").distinct(), "pairs")
    kind = pairs.schema["d"].dataType.simpleString()
    start = nodes.select("node").distinct().withColumn("label", F.col("node"))
    paths = materialize(start.select("node", "label", F.lit(None).cast(kind).alias("most"), F.array("label").alias("labels"), F.array().cast(f"array<{kind}>").alias("mosts")), "paths")
    apart = pairs.select("a", "b", "d", F.col("a").alias("la"), F.col("b").alias("lb"))
    while True:
        offers = apart.select(F.explode(F.array(F.struct(F.col("la").alias("c"), F.col("lb").alias("to")), F.struct(F.col("lb").alias("c"), F.col("la").alias("to")))).alias("x"), "d", "a", "b").select("x.*", "d", "a", "b")
        took = materialize(offers.groupBy("c").agg(F.min(F.struct("d", "a", "b", "to")).alias("x")).select("c", "x.d", "x.to"), "took")
        if took.isEmpty():
            break
        joined = components(took.select(F.col("c").alias("node")), took.select(F.col("c").alias("a"), F.col("to").alias("b")))
        new = materialize(took.select(F.col("c").alias("label"), "d").join(joined.select(F.col("node").alias("label"), F.col("label").alias("root")), "label"), "joined")
        paths = paths.join(new, "label", "left").select("node", F.coalesce("root", "label").alias("label"), F.greatest("most", "d").alias("most"), "labels", "mosts")
        paths = materialize(paths.select("node", "label", "most", F.array_append("labels", F.col("label")).alias("labels"), F.array_append("mosts", F.col("most")).alias("mosts")), "paths")
        root = new.select(F.col("label").alias("la"), F.col("root").alias("ra")), new.select(F.col("label").alias("lb"), F.col("root").alias("rb"))
        apart = materialize(apart.join(root[0], "la").join(root[1], "lb").where("ra <> rb").select("a", "b", "d", F.col("ra").alias("la"), F.col("rb").alias("lb")), "apart")
    end = lambda k: paths.select(F.col("node").alias(k), F.struct("labels", "mosts").alias(f"p{k}"))
    both = pairs.join(end("a"), "a").join(end("b"), "b")
    met = F.aggregate(F.zip_with("pa.labels", "pb.labels", lambda x, y: x == y), F.lit(0), lambda n, same: n + F.when(same, 0).otherwise(1))  # labels differ, then agree
    return both.where(F.col("d") <= F.greatest(F.get("pa.mosts", met - 1), F.get("pb.mosts", met - 1))).select("a", "b", "d")
