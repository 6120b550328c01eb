"""G9 on sample rows: local maxima, thinned from the highest by distance, and how far each stands out.

A row is a sample (keys, pos, value); keys and positions are not null, a sample without a value is passed over. Nothing gathers a
signal: maxima and distances are windows over ranges of positions, prominence climbs a pyramid of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import brainvision
from . import ranges

#: Entries of a block of the pyramid, and rounds of thinning that one shuffle serves.
BLOCK, ROUNDS = 64, 6


def maxima(samples: DataFrame, keys: list[str], size: int = ranges.RANGE) -> DataFrame:
    """keys, pos, value of all samples above both neighbours; of a flat top the middle, rounded down. The ends are none."""
    s = samples.where(F.col("value").isNotNull()).select(*keys, F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value"))
    starts = ranges.neighbours(s, keys, "pos", {"__v": ("value", -1)}, size).where("__v IS NULL OR __v <> value").drop("__v")
    runs = ranges.neighbours(starts, keys, "pos", {"__a": ("value", -1), "__b": ("value", 1), "__end": ("pos", 1)}, size)
    return runs.where("value > __a AND value > __b").select(*keys, F.floor((F.col("pos") + F.col("__end") - 1) / 2).alias("pos"), "value")


def spaced(peaks: DataFrame, keys: list[str], gap: int, size: int = ranges.RANGE) -> DataFrame:
    """The peaks that stay when, from the highest on (of equal ones the later), each drops those less than `gap` positions away.

    In each round the peaks that are highest within reach stay and their neighbours go. Copies of the border rows allow ROUNDS rounds a
    shuffle; what is then still undecided is written to the shared folder for the next ones, until nothing is left.
    """
    left = peaks.select(*keys, "pos", "value")
    if gap <= 1:
        return left
    reach, kept = gap - 1, None
    w = W.partitionBy(*keys, "__range").orderBy("pos").rangeBetween(-reach, reach)
    far, rank = 2 * ROUNDS * reach, F.struct("value", "pos")
    while True:
        h = ranges.halo(left, keys, "pos", far, far, max(size, far)).withColumns({"__open": F.lit(True), "__kept": F.lit(False)})
        for _ in range(ROUNDS):
            h = h.withColumn("__top", F.col("__open") & (F.max(F.when(F.col("__open"), rank)).over(w)["pos"] == F.col("pos")))
            h = h.withColumn("__near", F.max("__top").over(w))
            h = h.withColumns({"__kept": F.col("__kept") | F.col("__top"), "__open": F.col("__open") & ~F.col("__near")})
        out = brainvision.stored(h.where("__own AND (__open OR __kept)").select(*keys, "pos", "value", "__open"))
        done = out.where("NOT __open").drop("__open")
        kept = done if kept is None else kept.unionByName(done)
        left = out.where("__open").drop("__open")
        if left.isEmpty():
            return kept


def _pyramid(samples: DataFrame, keys: list[str], levels: int, block: int) -> list[DataFrame]:
    """Tables of keys, block, entries (i, lo, hi): of samples, then of the blocks below; at most `block` entries each."""
    out, rows = [], samples.where(F.col("value").isNotNull()).select(*keys, F.col("pos").cast("long").alias("i"), F.col("value").cast("double").alias("lo"), F.col("value").cast("double").alias("hi"))
    for _ in range(levels):
        grouped = rows.groupBy(*keys, F.floor(F.col("i") / block).alias("__block"))
        out.append(grouped.agg(F.sort_array(F.collect_list(F.struct("i", "lo", "hi"))).alias("__e")))
        rows = rows.groupBy(*keys, F.floor(F.col("i") / block).alias("i")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return out


def prominences(peaks: DataFrame, samples: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """peaks with `prominence`: the height above the higher of the lowest samples on both sides, each up to the next strictly higher sample or the end.

    Either side looks through the rest of its block, then of the block above, and so on up to a higher one; then down to where that begins.
    """
    last = samples.agg(F.max("pos")).first()[0] or 0
    levels = 1
    while block**levels <= last:
        levels += 1
    tables = _pyramid(samples, keys, levels, block)
    p = peaks.select(*keys, "pos", "value", F.explode(F.array(F.lit(-1), F.lit(1))).alias("__side"), F.col("pos").alias("__at"), F.col("value").alias("__low"), F.lit(None).cast("int").alias("__level"))
    cols = p.columns

    def step(p: DataFrame, j: int, own: Column, moving: Column, rest: Column, missed: Column) -> DataFrame:
        d = p.withColumn("__block", own).join(tables[j], [*keys, "__block"], "left")
        d = d.withColumn("__r", F.when(F.col("__side") > 0, rest).otherwise(F.reverse(rest)))
        d = d.withColumn("__k", F.array_position(F.transform("__r", lambda e: e["hi"] > F.col("value")), F.lit(True)).cast("int"))
        passed = F.when(F.col("__k") > 0, F.slice("__r", 1, F.col("__k") - 1)).otherwise(F.col("__r"))
        low = F.least("__low", F.array_min(F.transform(passed, lambda e: e["lo"])))
        return d.select(
            *[c for c in cols if not c.startswith("__") or c == "__side"], F.when(moving, F.when(F.col("__k") > 0, F.get("__r", F.col("__k") - 1)["i"]).otherwise(missed)).otherwise(F.col("__at")).alias("__at"),
            F.when(moving, low).otherwise(F.col("__low")).alias("__low"), F.when(moving & (F.col("__k") > 0), F.lit(j)).otherwise(F.col("__level")).alias("__level"))

    up = F.floor(F.col("__at") / block)
    for j in range(levels):
        beyond = F.filter("__e", lambda e: F.when(F.col("__side") > 0, e["i"] > F.col("__at")).otherwise(e["i"] < F.col("__at")))
        p = step(p, j, up, F.col("__level").isNull(), beyond, up)
    for j in range(levels - 2, -1, -1):
        p = step(p, j, F.col("__at"), F.coalesce(F.col("__level") > j, F.lit(False)), F.col("__e"), F.col("__at"))
    return p.groupBy(*keys, "pos").agg(F.first("value").alias("value"), (F.first("value") - F.max("__low")).alias("prominence"))


def find(samples: DataFrame, keys: list[str], distance: float, size: int = ranges.RANGE, block: int = BLOCK) -> DataFrame:
    """keys, pos, value, prominence of the maxima that stay at `distance`; a caller keeps those that stand out enough. An empty table gives none."""
    gap = -int(-distance // 1)
    return prominences(spaced(maxima(samples, keys, size), keys, gap, size), samples, keys, block)
