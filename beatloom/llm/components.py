"""Connected components of an edge table, as Spark jobs.

Labels spread along edges to the least id, and each round also follows labels of labels, so the rounds grow with
the logarithm of a component's diameter. Edges are contracted first: a node that several tasks joined to different least
ids keeps one edge, and those ids are joined to each other, so that equal edges fall together. Each round is written to the shared folder. A node with very many edges
is an ordinary skewed join between two stored tables, which Spark splits; messages are reduced before they are
shuffled. Nothing but the count of changed labels reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MOST_ROUNDS = 60


def contracted(edges: DataFrame) -> DataFrame:
    """a, b: edges with the same components, where a node's lesser neighbours hang on the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    between = down.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return least.select("a", F.col("least").alias("b")).unionAll(between).distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, component (the least id reachable) of every id in the edges a, b. edges is a stored table."""
    edges = common.stored(contracted(edges), "cc-contracted")
    both = common.stored(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "cc-edges")
    labels = common.stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("id"), "label"), "cc-labels")
    for _ in range(MOST_ROUNDS):
        sent = both.join(labels.select(F.col("id").alias("a"), "label"), "a").groupBy(F.col("b").alias("id")).agg(F.min("label").alias("label"))
        jump = labels.join(labels.select(F.col("id").alias("label"), F.col("label").alias("label2")), "label").select("id", F.col("label2").alias("label"))
        old = labels.select("id", "label", F.lit(1).alias("old"))
        new = sent.withColumn("old", F.lit(0)).unionAll(jump.withColumn("old", F.lit(0))).unionAll(old)
        new = new.groupBy("id").agg(F.min("label").alias("label"), F.min(F.when(F.col("old") == 1, F.col("label"))).alias("before"))
        new = common.stored(new, "cc-labels")
        changed = new.where("label <> before").limit(1).count()
        common.drop_stored(labels)
        labels = new.select("id", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("components did not settle")
