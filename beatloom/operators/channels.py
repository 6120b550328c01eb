"""Target channels to available ones: exact, any case, neighbours in rank order (exact, then any case), else a placeholder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import NEIGHBOURS


def priorities(spark: SparkSession, neighbours: dict[str, tuple[str, ...]] = NEIGHBOURS) -> DataFrame:
    """target, target_pos, wanted, rank; rank 0 is the target itself. A few dozen rows, fixed by the table above."""
    rows = [(t, i, w, r) for i, (t, near) in enumerate(neighbours.items()) for r, w in enumerate((t, *near))]
    return spark.createDataFrame(rows, "target string, target_pos int, wanted string, rank int")


def channel_map(channels: DataFrame, prio: DataFrame, keys: list[str]) -> DataFrame:
    """keys, target, target_pos, mapped_to, method, ch_pos (-1 for placeholders), from keys, channel, ch_pos.

    A channel may serve several targets. One pass: candidates meet on the lower-case name and each target keeps the best by
    (rank, exact before any case, position).
    """
    p = prio.withColumn("low", F.lower("wanted"))
    cand = channels.withColumn("low", F.lower("channel")).join(F.broadcast(p), "low")
    best = F.min(F.struct("rank", (F.col("channel") != F.col("wanted")).cast("int").alias("other_case"), "ch_pos", "channel"))
    found = cand.groupBy(*keys, "target").agg(best.alias("b"))
    every = channels.select(*keys).distinct().join(F.broadcast(prio.where("rank = 0").select("target", "target_pos")))
    j = every.join(found, [*keys, "target"], "left")
    near = F.concat(F.when(F.col("b.other_case") == 1, "neighbor_case(").otherwise("neighbor("), F.col("b.channel"), F.lit(")"))
    method = F.when(F.col("b").isNull(), "placeholder").when(F.col("b.rank") > 0, near).when(F.col("b.other_case") == 1, "case_insensitive").otherwise("exact")
    return j.select(*keys, "target", "target_pos", F.coalesce("b.channel", F.lit("ZERO_PLACEHOLDER")).alias("mapped_to"), method.alias("method"), F.coalesce("b.ch_pos", F.lit(-1)).alias("ch_pos"))
