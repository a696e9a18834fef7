"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgraph.llm.common import discard, saved


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of the edges (a, b) reaches. Ids without an edge are not listed.

    Every round points each id at its smallest neighbour and links its other neighbours there too; the round's edges
    are stored, so lineage stays short and a lost executor costs one round. Paths shorten by about half a round.
    """
    arcs = saved(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "arcs")
    while True:
        # Large star: what lies above an id is linked to the smallest of its neighbours and itself.
        both = arcs.union(arcs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: what lies below an id, and the id, are linked to the smallest of them.
        large = saved(large, "arcs")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").union(least.select("u", F.col("m").alias("v")))
        small = saved(small.distinct(), "arcs")
        changed = small.join(arcs, ["u", "v"], "left_anti").limit(1).count() or arcs.join(small, ["u", "v"], "left_anti").limit(1).count()
        discard(arcs, large)
        arcs = small
        if not changed:
            break
    roots = arcs.select("v").distinct()
    out = saved(arcs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select(F.col("v").alias("id"), F.col("v").alias("component"))), "components")
    discard(arcs)
    return out
