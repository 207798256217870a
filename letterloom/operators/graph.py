"""Connected components by label propagation in the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.runtime import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of the component of each node of ``edges`` (a, b).

    Each round takes the least label of the neighbours and then that label's own label, so that long chains shrink by
    halves. A node with very many neighbours is a group of pre-aggregated minima and never gathered. Null ends are left
    out, repeated edges and loops change nothing, no edges give no rows.
    """
    edges = edges.where("a is not null and b is not null").select("a", "b")
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "component-edges")
    labels = written(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "component-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("near"), F.col("label").alias("old"))
        far = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        new = written(new.join(far, "near", "left").select("node", F.least("near", F.coalesce("far", "near")).alias("label"), "old"), "component-labels")
        discard(labels)
        labels = new.select("node", "label")
        if not new.where("label <> old").limit(1).count():
            discard(both)
            return labels
