"""Mixing sources to target weights by hash-threshold histograms. DataFrame operations only.

Every document has a fixed key, nine hexadecimal digits of a hash of its id. A source that gives T words of
its S takes every document floor(T / S) times and, of the rest, those whose key lies below a threshold. The
threshold is found without sorting: sum words by source and the key's first three digits, find the bucket
where the running sum passes the rest, sum only that bucket by the next three digits, and again. A smaller
target keeps a subset of what a larger one keeps, so budgets nest.

Sources are a dimension: one row each, aggregated before any shuffle, so a source with a third of all rows is
no hot spot. Their targets depend on all of them in order, so the table of sources, and only that, passes one task. Joins with the per-source table are left to Spark, which broadcasts it only below its size limit.

Cases: null text has size 0; a null source is a source of its own, ordered last; a null id hashes as a fixed text;
repeated rows share their key and are kept or left together; sources without words take 0; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
DIGITS, LEVELS = 3, 3


def _digits() -> list[Column]:
    return [common.hex_key(F.col("doc_id"), DIGITS, 1 + DIGITS * i).cast("int").alias(f"k{i + 1}") for i in range(LEVELS)]


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the key's digits k1, k2, k3 of every document."""
    return docs.select("doc_id", "source", common.word_count(F.col("text")).alias("size"), *_digits())


def source_targets(words: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target: shares by weight of all words, no target above `most` times its source.

    The final shares fill all sources to one level of target / weight, cut at each cap: sources are ordered by the
    level at which they are full, and the level is the least one at which all words are given out.
    """
    by_source = words.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    everything, full_at = W.partitionBy(), W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = full_at.rowsBetween(W.unboundedPreceding, -1)
    s = s.select(
        "*", F.sum("source_size").over(everything).alias("total"), F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("caps_before"), F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weights_before"),
    )
    # With the sources before this one full, the others stand at this level.
    s = s.withColumn("level", (F.col("total") - F.col("caps_before")) / (F.col("weights") - F.col("weights_before")))
    first_open = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("caps_before", "level"))).over(everything)
    level = first_open["level"]
    return s.select("source", "source_size", F.least(F.col("cap"), level * F.col("weight")).alias("target"))


def _before(keys: list[str], limits: list[str]) -> Column:
    """The key's digits come before the limit's, in order of digits."""
    out = F.lit(False)
    for k, b in reversed(list(zip(keys, limits, strict=True))):
        out = (F.col(k) < F.col(b)) | ((F.col(k) == F.col(b)) & out)
    return out


def thresholds(words: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: repeats every document has, and the limit b1, b2, b3 with `last` for what the rest adds.

    Documents before the limit are taken once more; those at the limit too if `last` holds, which is when
    that comes nearer to the target.
    """
    spare = F.when(F.col("source_size") > 0, F.col("target") - F.col("repeats") * F.col("source_size")).otherwise(0.0)
    state = targets.withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    state = state.withColumn("rest", spare)
    for i in range(1, LEVELS + 1):
        state = common.stored(state, f"mix-level{i}")
        known = [f"b{j}" for j in range(1, i)]
        side = state.select(F.col("source").alias("s"), "rest", *known)
        inside = reduce(lambda c, j: c & (F.col(f"k{j}") == F.col(f"b{j}")), range(1, i), F.col("source").eqNullSafe(F.col("s")))
        hist = words.join(side, inside).groupBy("source", f"k{i}").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
        w = W.partitionBy("source").orderBy(f"k{i}")
        cum = hist.withColumn("upto", F.sum("n").over(w))
        # the boundary bucket: the first whose running sum passes what is still to be given
        bound = cum.where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min(F.struct(F.col(f"k{i}").alias("k"), (F.col("upto") - F.col("n")).alias("under"), F.col("n"))).alias("m"))
        bound = bound.select(F.col("source").alias("s2"), F.col("m.k").alias(f"b{i}"), F.col("m.under").alias("under"), F.col("m.n").alias("n"))
        state = state.join(bound, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")
        state = state.withColumn("rest", F.col("rest") - F.coalesce(F.col("under"), F.lit(0))).drop("under")
        if i < LEVELS:
            state = state.drop("n")
    return common.stored(state.withColumn("last", F.coalesce(F.col("n") - F.col("rest") < F.col("rest"), F.lit(False))).drop("n"), "mix-limits")


KEYS, ENDS = [f"k{i}" for i in range(1, LEVELS + 1)], [f"b{i}" for i in range(1, LEVELS + 1)]


def _copies(key: str, limit: str, most: int) -> Column:
    """How often a document is taken, from a struct of its key's digits and one of its source's limits."""
    keys, ends = [f"{key}.{k}" for k in KEYS], [f"{limit}.{b}" for b in ENDS]
    at = reduce(lambda a, b: a & b, [F.col(k) == F.col(b) for k, b in zip(keys, ends, strict=True)])
    extra = F.when(F.col(ends[0]).isNull(), False).otherwise(F.coalesce(_before(keys, ends) | (at & F.col(f"{limit}.last")), F.lit(False)))
    return F.least(F.col(f"{limit}.repeats") + extra.cast("long"), F.lit(most).cast("long"))


def mix(words: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """Adds source_size, target and copies, the times that the mix takes each document, to a stored table of sized()."""
    limits = thresholds(words, source_targets(words, weights, most))
    limits = limits.select(F.col("source").alias("__source"), "source_size", "target", F.struct("repeats", *ENDS, "last").alias("__limit"))
    out = words.withColumn("__key", F.struct(*KEYS)).join(limits, F.col("source").eqNullSafe(F.col("__source")))
    return out.withColumn("copies", _copies("__key", "__limit", most)).drop("__source", "__limit", "__key")


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """The documents, all columns as they are, as often as the mix takes them.

    Every row is looked up by its own source and key, never joined with others by its id, so rows without an id or with equal
    ids stay apart; texts are not shuffled unless the table of sources is too large to be sent to the tasks.
    """
    words = common.stored(sized(docs), "mix-words")
    limits = thresholds(words, source_targets(words, weights, most)).select(F.col("source").alias("__source"), F.struct("repeats", *ENDS, "last").alias("__limit"))
    out = docs.withColumn("__key", F.struct(*_digits())).join(limits, docs["source"].eqNullSafe(F.col("__source")))
    out = out.withColumn("__copies", _copies("__key", "__limit", most)).where("__copies > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)


def op10_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words the mix takes of every document."""
    words = common.stored(sized(common.table(spark, sf_dir, "documents")), "mix-words")
    out = mix(words)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '~')), 1, 9) AS k FROM documents),
g AS (SELECT source, CAST(sum(size) AS DOUBLE) AS s FROM w GROUP BY source),
o AS (SELECT source, s, 3 * s AS cap, CAST((row_number() OVER (ORDER BY source IS NULL, CAST(source AS BLOB)) - 1) % 3 + 1 AS DOUBLE) AS wt FROM g),
c AS (SELECT *, sum(s) OVER () AS tot, sum(wt) OVER () AS wts,
        coalesce(sum(cap) OVER q, 0) AS cb, coalesce(sum(wt) OVER q, 0) AS wb
      FROM o WINDOW q AS (ORDER BY cap / wt, source IS NULL, CAST(source AS BLOB) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (tot - cb) / (wts - wb) AS lvl FROM c),
v AS (SELECT arg_min(lvl, cb) AS lv FROM l WHERE lvl * wt <= cap),
t AS (SELECT source, s, least(cap, lv * wt) AS target FROM l, v),
r AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS rep FROM t),
h AS (SELECT source, k, sum(size) AS n FROM w GROUP BY source, k),
u AS (SELECT h.source, k, n, sum(n) OVER (PARTITION BY h.source ORDER BY k) AS upto FROM h),
b AS (SELECT u.source, k, CASE WHEN upto <= target - rep * s THEN 1
             WHEN upto - n <= target - rep * s AND upto - (target - rep * s) < (target - rep * s) - (upto - n) THEN 1 ELSE 0 END AS x
      FROM u JOIN r ON u.source IS NOT DISTINCT FROM r.source)
SELECT w.doc_id, w.size, CAST(r.s AS BIGINT) AS source_size, r.target,
       CAST(least(r.rep + b.x, 3) AS BIGINT) * w.size AS taken
FROM w JOIN r ON w.source IS NOT DISTINCT FROM r.source
JOIN b ON w.source IS NOT DISTINCT FROM b.source AND w.k = b.k
"""
