"""Exact medians by selection. No task holds the values of a key: histograms by prefix pick out the values around the middle.

A value's prefix is its sign and its base-2 logarithm, cut ever finer; prefixes follow the order of values. Each step counts rows by key and
prefix, inside tasks before the shuffle, and looks further only at the rows of the prefix that holds a middle rank. What is picked, two rows a
key, is written to the shared folder; the rows are read once a step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import brainvision

#: Prefixes an octave, step by step; after the last, or where no picked prefix has more than SMALL rows, values themselves are counted.
FINENESS, SMALL = (2**4, 2**13, 2**22), 65_536


def _prefix(v: Column, fineness: int) -> Column:
    # from 2**-1100 up, below all doubles, so that a larger size always has a larger number and 0 lies between the signs
    size = F.floor((F.log2(F.abs(v)) + 1100) * fineness) + 1
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, size).otherwise(-size)


def _pick(counts: DataFrame, keys: list[str], by: str, ranks: DataFrame) -> DataFrame:
    """keys, by, side, n, rank: the entry of `by` that holds each rank (0 is the smallest), its rows, and the rank inside it."""
    w = W.partitionBy(*keys, "__side").orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    c = counts.join(ranks, [*keys, "__side"] if "__side" in counts.columns else keys)
    c = c.withColumn("__below", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    hit = (F.col("__below") <= F.col("__rank")) & (F.col("__rank") < F.col("__below") + F.col("__n"))
    return c.where(hit).select(*keys, by, "__side", "__n", (F.col("__rank") - F.col("__below")).alias("__rank"))


def exact(df: DataFrame, keys: list[str], value: str, out: str, fineness: tuple[int, ...] = FINENESS, small: int = SMALL) -> DataFrame:
    """keys and the median of the non-null values, for an even count the mean of the two in the middle; keys without a value are left out.

    Keys are not null, values finite numbers. The result equals that of all values sorted, whatever their ties.
    """
    v = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    first = v.groupBy(*keys, _prefix(F.col("__v"), fineness[0]).alias("__by")).agg(F.count("*").alias("__n"))
    total = first.groupBy(*keys).agg(F.sum("__n").alias("__t"))
    middle = F.array(F.struct(F.lit(0).alias("side"), F.floor((F.col("__t") - 1) / 2).alias("rank")), F.struct(F.lit(1).alias("side"), F.floor(F.col("__t") / 2).alias("rank")))
    ranks = total.select(*keys, F.explode(middle).alias("m")).select(*keys, F.col("m.side").alias("__side"), F.col("m.rank").alias("__rank"))
    picked, rows = brainvision.stored(_pick(first, keys, "__by", ranks)), v
    steps = list(fineness)
    while steps:
        now = steps.pop(0)
        if (picked.agg(F.max("__n")).first()[0] or 0) <= small:
            steps = []
        deeper = _prefix(F.col("__v"), steps[0]) if steps else F.col("__v")
        # both ranks mostly have one prefix: its rows are kept once
        rows = rows.withColumn("__by", _prefix(F.col("__v"), now)).join(picked.select(*keys, "__by").distinct(), [*keys, "__by"], "left_semi")
        inside = rows.groupBy(*keys, "__by", deeper.alias("__next")).agg(F.count("*").alias("__n"))
        c = inside.join(picked.drop("__n"), [*keys, "__by"]).drop("__by", "__rank")
        picked = brainvision.stored(_pick(c, keys, "__next", picked.select(*keys, "__side", "__rank")).withColumnRenamed("__next", "__by"))
        rows = rows.drop("__by")
    return picked.groupBy(*keys).agg(((F.min("__by") + F.max("__by")) / 2).alias(out))
