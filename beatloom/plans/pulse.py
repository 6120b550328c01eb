"""G15 over peaks: interval and pulse-shape features as windows and groups; a row is a sample, so no signal gathers in a cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ranges, windows
from ..params import PPG_FEATURES


def intervals(peaks: DataFrame, keys: list[str], fs: float) -> DataFrame:
    """Keys, n and the features of the intervals between peaks, in milliseconds."""
    w = W.partitionBy(*keys).orderBy("pos")
    ibi = peaks.select(*keys, "pos", ((F.col("pos") - F.lag("pos").over(w)) / fs * 1000).alias("ibi"), (F.row_number().over(w) - 2).alias("t"))
    d = ibi.withColumn("d1", F.col("ibi") - F.lag("ibi").over(w))
    t = windows.trend(d.where("ibi IS NOT NULL"), keys, "t", "ibi")
    n = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("d1").alias("ibi_d1_mean"))
    named = {"mean": "ibi_mean", "range": "ibi_range", "slope": "ibi_slope", "r2": "ibi_r2", "cv": "ibi_samp_en"}
    return n.join(t.select(*keys, *[F.col(a).alias(b) for a, b in named.items()]), keys, "left")


def pulses(samples: DataFrame, peaks: DataFrame, keys: list[str], fs: float, shortest: int = 5) -> DataFrame:
    """Keys, pos, stop, amp, rise and width (milliseconds) and area of each pulse, from a peak up to the next.

    A sample belongs to the last peak at or before it; the half-height is looked up by the pulse.
    """
    seg = windows.segments(peaks.select(*keys, "pos"), keys, "pos", shortest)
    at = samples.select(*keys, "pos", "value").join(peaks.select(*keys, "pos", F.col("pos").alias("peak")), [*keys, "pos"], "left")
    inside = ranges.carried(at.withColumnRenamed("peak", "__peak"), keys, "pos", "__peak", "peak").drop("__peak").withColumnRenamed("pos", "i").join(seg.withColumnRenamed("pos", "peak"), [*keys, "peak"])
    inside = inside.withColumn("after", F.lead("value").over(W.partitionBy(*keys, "peak").orderBy("i")))
    size = inside.groupBy(*keys, "peak", "stop").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.min_by("i", F.struct(-F.col("value"), F.col("i"))).alias("top"), F.sum((F.col("value") + F.col("after")) / (2 * fs)).alias("area"))
    half = F.col("value") >= F.col("low") + (F.col("high") - F.col("low")) / 2
    wide = inside.join(size.select(*keys, "peak", "low", "high"), [*keys, "peak"]).where(half).groupBy(*keys, "peak").agg(((F.max("i") - F.min("i")) / fs * 1000).alias("width"))
    out = size.join(wide, [*keys, "peak"])
    return out.select(*keys, F.col("peak").alias("pos"), "stop", (F.col("high") - F.col("low")).alias("amp"), ((F.col("top") - F.col("peak")) / fs * 1000).alias("rise"), "width", "area")


def features(samples: DataFrame, peaks: DataFrame, keys: list[str], fs: float) -> DataFrame:
    """Keys and PPG_FEATURES of every key that has samples; zeros for fewer than 3 peaks."""
    i = intervals(peaks, keys, fs).where("n >= 3").drop("n")
    p = pulses(samples, peaks, keys, fs).groupBy(*keys).agg(
        F.avg("amp").alias("ppg_amp_mean"), F.var_pop("amp").alias("ppg_amp_var"), F.avg("rise").alias("ppg_rise_mean"), F.avg("width").alias("ppg_width_mean"),
        F.avg("area").alias("ppg_area_mean"), F.var_pop("area").alias("ppg_area_var"))
    out = samples.select(*keys).distinct().join(i.join(p, keys, "left"), keys, "left")
    return out.select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in PPG_FEATURES])
