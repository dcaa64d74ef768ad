"""Connected components by smallest labels with pointer jumping.

Every round is two joins and a written table, so lineage and driver memory stay flat; the rounds grow with
the logarithm of the longest chain, not with the number of vertices. Nothing but a count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.staging import Stages


def connected_components(edges: DataFrame, stages: Stages | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every endpoint; component is the smallest node reachable.

    Direction, loops and repeated edges don't matter; an edge with a null end is ignored; no edges give no rows.
    """
    stages = stages or Stages(edges.sparkSession, "components")
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = stages.write(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stages.write(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n")).agg(F.min("component").alias("least"))
        hooked = labels.join(near, F.col("node") == F.col("n")).select("node", F.least("component", "least").alias("target"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("n2"), F.col("component").alias("c2"))
        moved = stages.write(hooked.join(jump, F.col("target") == F.col("n2")).select("node", F.least("target", "c2").alias("component"), "old"))
        done = moved.where("component <> old").limit(1).count() == 0
        stages.drop(labels)
        labels = moved
        if done:
            stages.drop(both)
            return labels.select("node", "component")
