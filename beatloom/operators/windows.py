"""Ordered operators within a key (a recording): W1-W5, A11-A15. `order` is a position, a long from 0; a key of any size is cut into ranges of `size` positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import brainvision
from . import medians
from .ranges import RANGE, framed, neighbours


def diff(df: DataFrame, keys: list[str], order: str, value: str, out: str = "rr", size: int = RANGE) -> DataFrame:
    """W1."""
    return neighbours(df, keys, order, {"__a": (value, -1)}, size).withColumn(out, F.col(value) - F.col("__a")).drop("__a")


def clean_beats(df: DataFrame, keys: list[str], order: str, value: str, tolerance: float = 0.3, size: int = RANGE) -> DataFrame:
    """Drops the later beat of an interval that is off the median of all; rr is then taken over what is left."""
    d = brainvision.stored(diff(df, keys, order, value, size=size))
    d = d.join(d.groupBy(*keys).agg(F.count("*").alias("__n")), keys).join(medians.exact(d, keys, "rr", "__m"), keys, "left")
    keep = (F.col("__n") < 3) | F.col("rr").isNull() | (F.abs(F.col("rr") - F.col("__m")) < tolerance * F.col("__m"))
    return diff(d.where(keep).drop("__m", "__n", "rr"), keys, order, value, size=size)


def moving_average(df: DataFrame, keys: list[str], order: str, value: str, width: int, size: int = RANGE) -> DataFrame:
    """Zero-padded at the edges and where a position is missing, so sums are divided by the full width."""
    return framed(df, keys, order, width // 2, width - width // 2 - 1, "smooth", F.col(value), size).withColumn("smooth", F.col("smooth") / width)


def local_maxima(df: DataFrame, keys: list[str], order: str, value: str, size: int = RANGE) -> DataFrame:
    """G9, first part: samples strictly above both neighbours; ends are none. `peaks` has flat tops, distance and prominence."""
    d = neighbours(df, keys, order, {"__a": (value, -1), "__b": (value, 1)}, size)
    return d.where((F.col(value) > F.col("__a")) & (F.col(value) > F.col("__b"))).drop("__a", "__b")


def segments(df: DataFrame, keys: list[str], pos: str, shortest: int = 5, size: int = RANGE) -> DataFrame:
    """[pos, next pos) of consecutive peaks; segments under `shortest` go."""
    d = neighbours(df, keys, pos, {"stop": (pos, 1)}, size)
    return d.where(F.col("stop") - F.col(pos) >= shortest)


def refine(peaks: DataFrame, samples: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """For each peak, the first highest sample within [peak - reach, peak + reach)."""
    near = peaks.withColumn("pos", F.explode(F.sequence(F.col("peak") - reach, F.col("peak") + reach - 1))).join(samples, [*keys, "pos"])
    return near.groupBy(*keys, "peak").agg(F.max_by("pos", F.struct("value", -F.col("pos"))).alias("refined"))


def trend(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope, intercept and R2 (with the 1e-8 in it) of y on x; mean, range, deviation, variance, coefficient of variation."""
    g = df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"),
        F.avg(y).alias("mean"), (F.max(y) - F.min(y)).alias("range"), F.stddev_pop(y).alias("std"), F.var_pop(y).alias("var"))
    rest = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    return g.withColumns({"r2": 1 - rest / (F.col("syy") + 1e-8), "cv": F.col("std") / (F.col("mean") + 1e-8)}).drop("syy", "sxy")
