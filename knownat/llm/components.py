"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownat.llm.store import written


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` edges to ``(node, label)``: every node that has an edge, and the smallest node it is connected with.

    Each round sends every node to its smallest neighbour and joins the edges to the new ends, so chains shrink geometrically; the edge
    table only ever gets smaller.  Null ends and loops are ignored.
    """
    edges = edges.select("a", "b").where("a <> b").distinct()
    edges = written(edges, "edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label"))
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other")
        parent = written(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("parent")), "parents")
        labels = written(
            labels.join(parent.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("parent", "label").alias("label")),
            "labels",
        )
        edges = written(
            edges.join(parent.toDF("a", "pa"), "a").join(parent.toDF("b", "pb"), "b").where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
            "edges",
        )
    return labels
