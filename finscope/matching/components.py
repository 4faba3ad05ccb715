"""Connected components of an edge table, by contraction of edges to least labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finscope.scratch import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the least node it can reach.

    Each round takes every node to the least of its neighbours and on to the
    least of that one's, and both ends of all edges with them. What has become a
    loop or equal goes, so that later rounds have few edges. Edges with a null end
    are ignored. A round's tables are written to the shared folder, so a lost
    executor costs one round at most. A node with many neighbours is aggregated
    before it is shuffled, and joins have one row a node on one side.
    """
    def different(u, v) -> DataFrame:
        ends = left.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"))
        return written(ends.where("u <> v").distinct(), "edges")

    given = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    every = written(given.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "nodes")
    labels = every.select("node", F.col("node").alias("root"))
    left = given
    left = different("u", "v")
    while left.limit(1).count():
        near = left.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))  # u is the lesser end
        near = written(near, "labels")
        up = near.select(F.col("node").alias("root"), F.col("root").alias("upper"))
        step = written(near.join(up, "root", "left").select("node", F.coalesce("upper", "root").alias("root")), "labels")
        on = step.select("node", F.col("root").alias("to"))
        left = left.join(on, left["u"] == on["node"], "left").select(F.coalesce("to", "u").alias("u"), "v")
        left = left.join(on, left["v"] == on["node"], "left").select("u", F.coalesce("to", "v").alias("v"))
        left = different("u", "v")
        labels = labels.join(on.withColumnRenamed("node", "at"), F.col("root") == F.col("at"), "left").select("node", F.coalesce("to", "root").alias("root"))
        labels = written(labels, "labels")
    return labels
