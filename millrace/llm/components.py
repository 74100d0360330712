"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


def components(edges: DataFrame) -> DataFrame:
    """``id, label`` for each id in ``edges (a, b)``: the smallest id it is connected with.

    Each round points every vertex at the smallest of itself and its neighbours, follows the pointers to their ends by doubling, and
    rewrites the edges between what is left: only local minima stay, and a path of n vertices takes log2(n) joins. Groupings are
    minima and combine before the shuffle, so a star is no hot spot. Null ends are dropped; an empty table gives an empty table.
    Tables of past rounds are deleted from the shared folder; the labels stay there.
    """
    spark, held = edges.sparkSession, []

    def kept(df: DataFrame, what: str) -> DataFrame:
        out, path = written(df, what)
        held.append(path)
        return out

    rest = kept(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    both = rest.select(F.col("a").alias("id")).union(rest.select("b")).distinct()
    labels, labels_at = written(both.select("id", F.col("id").alias("label")), "labels")
    while rest.limit(1).count():
        around = rest.select(F.col("a").alias("_v"), F.col("b").alias("_n")).union(rest.select("b", "a"))
        step = kept(around.groupBy("_v").agg(F.min("_n").alias("_n")).select("_v", F.least("_v", "_n").alias("_to")), "pointers")
        while True:
            far = step.select(F.col("_v").alias("_v2"), F.col("_to").alias("_to2"))
            step = kept(step.join(far, F.col("_to") == F.col("_v2")).select("_v", F.col("_to2").alias("_to"), (F.col("_to") != F.col("_to2")).alias("_moved")), "pointers")
            if not step.filter("_moved").limit(1).count():
                break
            step = step.select("_v", "_to")
        step = step.select("_v", "_to")
        held.append(labels_at)
        labels, labels_at = written(labels.join(step, labels["label"] == step["_v"], "left").select("id", F.coalesce("_to", "label").alias("label")), "labels")
        to_b = step.select(F.col("_v").alias("_vb"), F.col("_to").alias("_tb"))
        moved = rest.join(step, rest["a"] == step["_v"]).join(to_b, rest["b"] == to_b["_vb"])
        done, held = held, []
        rest = kept(moved.select(F.least("_to", "_tb").alias("a"), F.greatest("_to", "_tb").alias("b")).filter("a <> b").distinct(), "edges")
        for path in done:
            remove(spark, path)
    for path in held:
        remove(spark, path)
    return labels
