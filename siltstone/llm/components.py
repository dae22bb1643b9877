"""Connected components of a distributed graph by repeated contraction.

In every round each node joins the one that comes first, in an order drawn anew
for the round, among itself, its neighbours and theirs; edges are carried over
to what the nodes have become. A star goes away in one round, and a constant
share of any other graph, so rounds grow with the logarithm of the graph. All
steps are minimums and joins; no neighbourhood is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.shared import store


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of edges (a, b); comp is the component's least
    node. No edges give no rows; loops and repeated edges do no harm."""
    left = store(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps = []
    while not left.isEmpty():
        turn = F.lit(len(steps))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda v: F.struct(F.xxhash64(turn, v).alias("h"), F.col(v).alias("v"))
        near = both.groupBy("a").agg(F.min(rank("b")).alias("near")).select("a", F.least(rank("a"), "near").alias("near"))
        best = both.join(near.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("near").alias("best")).join(near, "a")
        step = store(best.select(F.col("a").alias("node"), F.least("near", "best")["v"].alias("to")), "step")
        steps.append(step)
        moved = left.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        left = store(moved.filter("ta != tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    found = steps[0].select("node", F.col("to").alias("comp"))
    for step in steps[1:]:
        found = found.join(step.select(F.col("node").alias("comp"), "to"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    found = store(found, "components")
    least = found.groupBy("comp").agg(F.min("node").alias("least"))
    return found.join(least, "comp").select("node", F.col("least").alias("comp"))
