"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def components(edges: DataFrame) -> DataFrame:
    """v, root for each vertex of edges (a, b, any one type, no nulls): root is the least vertex reachable from v.

    In each round a vertex takes the least label among its neighbours, then the label of its label, so the number of rounds
    grows with the logarithm of the longest chain. Minima are combined before they are shuffled, and labels are joined as
    plain columns, so a vertex with many edges is no group that one task must hold. No edges: no rows.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("root").alias("m"))
        once = labels.join(near, labels.v == near.a, "left").select("v", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        once = cut(once, "labels")
        up = once.select(F.col("v").alias("r"), F.col("root").alias("above"))
        new = once.join(up, once.root == up.r, "left").select("v", "old", F.least("root", "above").alias("root"))
        new = cut(new, "labels")
        changed = new.where("root < old").limit(1).count()
        for x in (labels, once):
            drop_cut(x)
        labels = new.select("v", "root")
        if not changed:
            drop_cut(both)
            return labels
