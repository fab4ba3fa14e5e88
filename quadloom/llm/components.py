"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import drop_path, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component is the smallest reachable node.

    Alternates large-star and small-star steps: every step only replaces edges by edges to a smaller
    neighbour of the same component, so the edge list never grows beyond its first size and converges
    in a logarithmic number of rounds. The smallest neighbour of each node is pre-aggregated before its
    shuffle and written out, so that the join back has plain exchanges on both sides and a hub with a
    third of all edges is split by Spark's skew join. Every round is a table in the shared folder.

    Empty input: no rows. Self loops and repeated edges do not matter; rows with a null end are ignored.
    """
    spark = edges.sparkSession
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now, path = materialise(edges, "cc")
    mark = None
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least, p1 = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
        large, p2 = materialise(both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "cc-large")
        small, p3 = materialise(large.groupBy("hi").agg(F.min("lo").alias("m")), "cc-small")
        moved = large.join(small, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after, p4 = materialise(moved.unionAll(small.select("hi", F.col("m").alias("lo"))).distinct(), "cc")
        then = after.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        for p in (path, p1, p2, p3):
            drop_path(spark, p)
        now, path = after, p4
        if then == mark:
            break
        mark = then
    # at the fixed point every edge leads straight to its component's smallest node
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
