"""Connected components of an edge table, as joins and aggregates."""

from pyspark.sql import functions as F

from firn.session import materialize


def components(edges, rounds=100):
    """(node, component): for every node of the edges `(a, b)` the smallest node it can reach.

    Every round takes the smallest label among a node's neighbours and then the label of that
    label, so long chains fold up in a logarithmic number of rounds. Each round is written to
    the shared folder. Nulls in the edges are left out; self-loops and repeats do no harm; an
    empty table gives no rows.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a IS NOT NULL AND b IS NOT NULL")
    both = materialize(e.union(e.select("b", "a")).distinct())
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        hop = materialize(labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "m").alias("hop")))
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("top"))
        new = materialize(hop.join(up, hop.hop == up.at).select("node", F.least("hop", "top").alias("label"), (F.least("hop", "top") < F.col("label")).alias("moved")))
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
