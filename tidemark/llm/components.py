"""Connected components of an edge table: smallest reachable id, by label passing with pointer jumps.

Edges and labels stay distributed. Each round is two joins and a pre-aggregated minimum, its
result is written to the shared folder, and rounds end when no label changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, label) for every node of `edges`; label is the smallest node of its component.

    Self loops and repeated edges are harmless; edges with a null end are ignored; no edges give no rows.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    both = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = lower.join(up, "label", "left").select("node", "was", F.least("label", "top").alias("label"))
        step = cut(jumped, "labels")
        changed = step.where("label <> was").limit(1).count()
        drop_cut(labels)
        labels = step.drop("was")
        labels.cut_path = step.cut_path
        if not changed:
            drop_cut(both)
            return labels
