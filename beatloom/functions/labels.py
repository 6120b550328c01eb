"""Event-label rules as column expressions: discovery (A7), rest test (F9), classification (F8), mapping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import CONDITION_INTS, DISCOVERY_PATTERNS, ECG_KEYWORDS, PPG_KEYWORDS, REST_KEYWORDS


def normal(label: Column) -> Column:
    return F.lower(F.trim(label))


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def has(label: Column, *parts: str) -> Column:
    return _any([F.contains(label, F.lit(p)) for p in parts])


def is_rest(label: Column) -> Column:
    """a rest keyword, alone or as the first or last part of the label."""
    return _any([(label == k) | F.startswith(label, F.lit(k + "_")) | F.endswith(label, F.lit("_" + k)) for k in REST_KEYWORDS])


def discover(label: Column) -> Column:
    """The first pattern group, in its order, that occurs in the label; null for none. `fast` precedes `fast_delay` (Q3)."""
    lab = normal(label)
    out = F.when(is_rest(lab), F.lit("rest"))
    for name, parts in DISCOVERY_PATTERNS:
        out = out.when(has(lab, *parts), F.lit(name))
    return out


def classify(label: Column, codes: dict[str, int] | None = None) -> Column:
    """F8: struct(name, code, is_rest); rules in order, then the exact names of `codes` (Q27), then (label, -1, false)."""
    codes = CONDITION_INTS if codes is None else codes
    lab = normal(label)

    def one(name: Column | str, code: int, rest: bool) -> Column:
        return F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), F.lit(code).alias("code"), F.lit(rest).alias("is_rest"))

    out = F.when(is_rest(lab), one("rest", -1, True))
    out = out.when(has(lab, "simul", "all_at_once"), one("simultaneous", codes.get("simultaneous", 0), False))
    out = out.when((has(lab, "fast") & has(lab, "delay", "del")) | has(lab, "fastdelay", "fast_delay"), one("fast_delay", codes.get("fast_delay", 3), False))
    out = out.when(has(lab, "slow") & ~has(lab, "fast"), one("slow", codes.get("slow", 1), False))
    out = out.when(has(lab, "fast") & ~has(lab, "delay", "slow"), one("fast", codes.get("fast", 2), False))
    for name, code in codes.items():
        out = out.when(lab == name, one(name, code, False))
    return out.otherwise(one(lab, -1, False))


def map_labels(events: DataFrame, label_map: DataFrame, label: str = "label") -> DataFrame:
    """Left join with a vocabulary of labels; labels that it lacks stay.

    The vocabulary has a row a label, however many events there are, so it is broadcast: events dealt out by label would be a few huge groups.
    """
    dim = label_map.select(normal(F.col("label")).alias("__lab"), F.col("condition").alias("__cond")).dropDuplicates(["__lab"])
    out = events.withColumn("__key", normal(F.col(label))).join(F.broadcast(dim), F.col("__key") == F.col("__lab"), "left")
    return out.withColumn("mapped", F.coalesce("__cond", "__key")).drop("__key", "__lab", "__cond")


def channel_type(name: Column) -> Column:
    """ECG keywords before PPG ones, as parts of the lower-case name; else EEG."""
    low = F.lower(name)
    return F.when(has(low, *ECG_KEYWORDS), "ecg").when(has(low, *PPG_KEYWORDS), "ppg").otherwise("eeg")
