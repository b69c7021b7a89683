"""Connected components of an edge table, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vane.plans.shared import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of edges (src, dst); component is the smallest node reachable.

    Each round contracts the graph: a node goes to the first of itself and its neighbours in a random order (a hash with a
    seed), and the edges between nodes that went to different ones remain. In a fresh order at most three quarters of the
    nodes with edges are expected to remain, whatever the graph and its ids, so rounds grow with the logarithm of the nodes
    and need no limit. An order serves two rounds, which is all that a star takes. The rounds' shrinking tables are then
    joined from the last to the first. Each is written to the shared folder, which cuts the lineage. Minima combine before
    the shuffle; hot nodes are plain shuffle joins, which adaptive execution can split.
    """
    alone = edges.where("src = dst").select(F.col("src").alias("node"))
    left = stored(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct(), "edges")
    moves = []
    while left.limit(1).count():
        seed = len(moves) // 2
        ranked = lambda c, seed=seed: F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("rank"), F.col(c).alias("node"))
        near = left.groupBy("src").agg(F.min(ranked("dst")).alias("near"))
        move = stored(near.select(F.col("src").alias("node"), F.least(ranked("src"), "near")["node"].alias("to")), "moves")
        side = lambda c, move=move: move.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        met = left.join(side("src"), "src").join(side("dst"), "dst").where("src_to <> dst_to")
        left = stored(met.select(F.col("src_to").alias("src"), F.col("dst_to").alias("dst")).distinct(), "edges")
        moves.append(move)
    if not moves:
        return alone.distinct().select("node", F.col("node").alias("component"))
    ends = moves.pop()
    while moves:
        later = ends.select(F.col("node").alias("at"), F.col("to").alias("end"))
        ends = stored(moves.pop().join(later, F.col("to") == F.col("at"), "left").select("node", F.coalesce("end", "to").alias("to")), "ends")
    least = ends.groupBy("to").agg(F.min("node").alias("component"))
    labels = stored(ends.join(least, "to").select("node", "component"), "labels")
    return labels.union(alone.join(labels, "node", "left_anti").distinct().select("node", F.col("node").alias("component")))
