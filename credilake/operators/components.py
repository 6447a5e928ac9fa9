"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credilake.session import materialize


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``id, component`` (smallest id of the component) for every endpoint of ``src, dst`` edges.

    Alternates large-star and small-star steps (Kiveris et al., SoCC 2014), which ends in O(log^2 n) rounds
    with every node hanging on its component's minimum. A step is a grouped minimum, combined map-side, and a
    join, so a node with very many edges is never gathered in one place. Each round is written out, which
    cuts lineage.
    """
    hi, lo = F.greatest("src", "dst"), F.least("src", "dst")
    current = materialize(
        edges.where(F.col("src") != F.col("dst")).select(hi.alias("u"), lo.alias("v")).distinct(), "edges"
    )
    for _ in range(max_rounds):
        # large star: larger neighbours of each node move to the node's minimum (itself included)
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = large.where(F.col("u") != F.col("v")).distinct()
        # small star: smaller neighbours of each node, and the node, move to the smallest neighbour
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(smallest.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v"))
        following = materialize(small.distinct(), "edges")
        same = (
            following.count() == current.count()
            and following.join(current, ["u", "v"], "left_anti").limit(1).count() == 0
        )
        current = following
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots).distinct()
