"""Connected components of an edge table, by smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthforge.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of ``edges`` (u, v), the smallest node it can reach.

    Each round takes the smallest label among a node's neighbours, a partial minimum per task, and then the label's
    own label; rounds are written to the shared folder.  A node with very many neighbours is one key of the join that
    brings its label to them; adaptive skew handling splits that key's rows, its label being one row on the other
    side.  An empty table has no components; edges with a null end and loops are left out.
    """
    links = stored(edges.where("u <> v").select("u", "v").unionByName(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), few=True)
    labels = stored(links.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")), few=True)
    while True:
        near = links.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        met = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("far"))
        step = met.join(jump, "new", "left").select("node", F.coalesce("far", "new").alias("component"), (F.coalesce("far", "new") != F.col("component")).alias("moved"))
        step = stored(step, few=True)
        labels = step.select("node", "component")
        if not step.where("moved").limit(1).count():
            return labels
