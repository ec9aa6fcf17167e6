"""Totals of all subtrees of a forest by parallel tree contraction, as join rounds."""

from pyspark.sql import functions as F

from firn.session import materialize


def subtree_totals(tree, values, rounds=500):
    """(node, <values>): for every node the sums of the values over its subtree, itself included.

    `tree` has `node` (unique, any type that can be compared), `parent` (null for roots, else
    a node) and number columns `values`. Every round rakes the nodes without children, adding
    their total to the parent, and compresses chains: a node with one child is taken out by the
    toss of a coin if its child stays, and the child then carries the node's share to the next
    node above. So a chain of any length folds up in a logarithmic number of rounds. Afterwards
    the nodes that were taken out get their totals back, last round first. Each round is written
    to the shared folder. An empty table gives no rows.
    """
    own, carried = [f"own{i}" for i in range(len(values))], [f"carried{i}" for i in range(len(values))]
    live = tree.select(
        "node", "parent", *[F.col(v).cast("long").alias(o) for v, o in zip(values, own)], *[F.lit(0).cast("long").alias(c) for c in carried])
    raked, spliced = [], []
    for number in range(rounds):
        kids = live.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n"), F.min("node").alias("child"))
        chain = (F.col("n") == 1) & F.col("parent").isNotNull() & (F.pmod(F.xxhash64("node", F.lit(number)), F.lit(2)) == 1)
        now = live.join(kids, "node", "left")
        now = materialize(now.withColumns({"n": F.coalesce("n", F.lit(0)), "out": F.coalesce(chain, F.lit(False))}))
        if now.isEmpty():
            return _expanded(raked, spliced, values, own, tree.select("node", *values))
        leaves = now.where("n = 0")
        raked.append(leaves.select("node", *own))
        # a chain node and its only child, which stays; both keys are unique
        above = now.where("out").select(F.col("node").alias("top"), F.col("parent").alias("up"), "child", *[F.col(o).alias(f"top_{o}") for o in own], *[F.col(c).alias(f"top_{c}") for c in carried])
        below = now.where("n > 0 AND NOT out").select("node", *carried)
        splice = materialize(above.join(below, above.child == below.node).select(
            "top", "child", "up", *[(F.col(f"top_{o}") + F.col(c)).alias(o) for o, c in zip(own, carried)],
            *[(F.col(f"top_{o}") + F.col(f"top_{c}")).alias(f"more_{c}") for o, c in zip(own, carried)]))
        any_splice = not splice.isEmpty()
        spliced.append(splice.select("top", "child", *own) if any_splice else None)
        gain = leaves.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(*[F.sum(F.col(o) + F.col(c)).alias(f"gain_{o}") for o, c in zip(own, carried)])
        left = now.where("n > 0").join(gain, "node", "left")
        if any_splice:
            left = left.join(splice.select(F.col("top").alias("node")), "node", "left_anti")
            left = left.join(splice.select(F.col("child").alias("node"), "up", *[f"more_{c}" for c in carried]), "node", "left")
        else:
            left = left.withColumns({"up": F.lit(None).cast(now.schema["parent"].dataType), **{f"more_{c}": F.lit(None).cast("long") for c in carried}})
        plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
        live = left.select(
            "node", F.coalesce("up", "parent").alias("parent"), *[plus(o, f"gain_{o}") for o in own], *[plus(c, f"more_{c}") for c in carried])
    raise RuntimeError(f"the tree did not fold up in {rounds} rounds; it holds a cycle or a parent that is no node")


def _expanded(raked, spliced, values, own, empty):
    """The totals of all nodes: those of raked ones stand, the others follow from their child's."""
    known = []
    for leaves, chain in zip(reversed(raked), reversed(spliced)):
        if chain is not None:  # the child left in a later round
            later = known[0]
            for part in known[1:]:
                later = later.unionByName(part)
            later = later.select(F.col("node").alias("child"), *[F.col(o).alias(f"of_{o}") for o in own])
            known.append(materialize(chain.join(later, "child").select(F.col("top").alias("node"), *[(F.col(o) + F.col(f"of_{o}")).alias(o) for o in own])))
        known.append(leaves)
    if not known:
        return empty
    out = known[0]
    for part in known[1:]:
        out = out.unionByName(part)
    return out.select("node", *[F.col(o).alias(v) for o, v in zip(own, values)])
