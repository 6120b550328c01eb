"""Windows over keys of any size: a key is cut into ranges of its positions, each a window group of its own.

What a row needs from beyond its range comes in one of two ways: rows near a border are copied into the next range (`halo`, for frames
of a fixed reach), or a table of a row a range carries the nearest rows across (`neighbours`, `carried`). No task gets more rows than a
range has, however many rows one key holds; only the table of ranges is ordered by key.

Keys and positions are not null; positions are longs from 0, each once a key, with or without gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Positions of a range.
RANGE = 65_536


def _ranged(df: DataFrame, pos: str, size: int) -> DataFrame:
    return df.withColumn("__range", F.floor(F.col(pos) / size))


def halo(df: DataFrame, keys: list[str], pos: str, before: int, after: int, size: int = RANGE) -> DataFrame:
    """df with __range and __own: each row in its own range and, with __own false, in those of which a frame of `before` to `after` positions reaches it."""
    p = F.col(pos)
    reached = F.sequence(F.greatest(F.floor((p - after) / size), F.lit(0)), F.floor((p + before) / size))
    return df.withColumn("__range", F.explode(reached)).withColumn("__own", F.col("__range") == F.floor(p / size))


def neighbours(df: DataFrame, keys: list[str], pos: str, wanted: dict[str, tuple[str, int]], size: int = RANGE) -> DataFrame:
    """df with a column for each of `wanted`: the value of a column in the key's row before (-1) or after (1), null where there is none."""
    names = sorted({c for c, _ in wanted.values()})
    row, w = F.struct(*names), W.partitionBy(*keys, "__range").orderBy(pos)
    r = _ranged(df, pos, size)
    over = W.partitionBy(*keys).orderBy("__range")
    edges = r.groupBy(*keys, "__range").agg(F.min_by(row, pos).alias("__first"), F.max_by(row, pos).alias("__last"))
    edges = edges.select(*keys, "__range", F.lag("__last").over(over).alias("__lo"), F.lead("__first").over(over).alias("__hi"))
    r = r.withColumns({"__p": F.lag(row).over(w), "__n": F.lead(row).over(w)}).join(edges, [*keys, "__range"], "left")
    side = {-1: F.coalesce("__p", "__lo"), 1: F.coalesce("__n", "__hi")}
    return r.select(*df.columns, *[side[step][c].alias(out) for out, (c, step) in wanted.items()])


def carried(df: DataFrame, keys: list[str], pos: str, value: str, out: str, size: int = RANGE) -> DataFrame:
    """df with `out`: the last non-null `value` of the key at or before each row."""
    r = _ranged(df, pos, size)
    edges = r.groupBy(*keys, "__range").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(pos))).alias("__end"))
    before = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    edges = edges.select(*keys, "__range", F.last("__end", ignorenulls=True).over(before).alias("__lo"))
    own = F.last(value, ignorenulls=True).over(W.partitionBy(*keys, "__range").orderBy(pos).rowsBetween(W.unboundedPreceding, 0))
    return r.withColumn("__o", own).join(edges, [*keys, "__range"], "left").select(*df.columns, F.coalesce("__o", "__lo").alias(out))


def framed(df: DataFrame, keys: list[str], pos: str, before: int, after: int, out: str, value: Column, size: int = RANGE) -> DataFrame:
    """df with `out`: the sum of `value` over the positions from `before` below to `after` above."""
    w = W.partitionBy(*keys, "__range").orderBy(pos).rangeBetween(-before, after)
    return halo(df, keys, pos, before, after, size).withColumn(out, F.sum(value).over(w)).where("__own").select(*df.columns, out)


def width(df: DataFrame, keys: list[str], order: str, most: int = RANGE) -> int:
    """The greatest power of two for which no key has over `most` rows in a range of so many values of `order`, a long; 1 where equal values alone are more.

    Only keys of more rows are looked at, counted by key and range, inside tasks before the shuffle; a number a size comes to the driver.
    """
    per_key = df.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(order).alias("__lo"), F.max(order).alias("__hi"))
    lo, hi, largest = per_key.agg(F.min("__lo"), F.max("__hi"), F.max("__n")).first()
    if lo is None:
        return 1
    # ranges begin at multiples of their size: above the numbers themselves, one holds all that are not negative
    top = max(int(abs(lo)).bit_length(), int(abs(hi)).bit_length())
    if largest <= most:
        return 1 << top
    hot = df.join(per_key.where(F.col("__n") > most).select(*keys), keys, "left_semi")
    while True:
        bits = max(top - 12, 0)
        fine = hot.groupBy(*keys, F.floor(F.col(order) / F.lit(1 << bits)).alias("__b")).agg(F.count("*").alias("__n"))
        by_size = fine.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(top - bits)))).withColumn("__b", F.expr("shiftright(__b, __s)"))
        counts = by_size.groupBy(*keys, "__s", "__b").agg(F.sum("__n").alias("__n")).groupBy("__s").agg(F.max("__n").alias("__n"))
        fits = [r["__s"] for r in counts.collect() if r["__n"] <= most]
        if fits or not bits:
            return 1 << (bits + max(fits, default=0))
        top = bits


def numbered(df: DataFrame, keys: list[str], order: str, ties: list[str], out: str, start: str, size: int) -> DataFrame:
    """df with `out`, the row's number from 0 within its key by `order` (a long, not null) and `ties`, and `start`, the key's least `order`."""
    r = _ranged(df, order, size)
    over = W.partitionBy(*keys).orderBy("__range")
    edges = r.groupBy(*keys, "__range").agg(F.count("*").alias("__n"), F.min(order).alias("__least"))
    edges = edges.select(
        *keys, "__range", F.coalesce(F.sum("__n").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.min("__least").over(W.partitionBy(*keys)).alias(start))
    r = r.withColumn("__k", F.row_number().over(W.partitionBy(*keys, "__range").orderBy(order, *ties)) - 1).join(edges, [*keys, "__range"], "left")
    return r.select(*df.columns, (F.col("__k") + F.col("__before")).cast("long").alias(out), start)
