"""Subject registry: channel classes (F1), status (F2), subject sets (F3, J8, T4, T7), counts and modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import channel_type


def registry(headers: DataFrame) -> DataFrame:
    """A row a subject from columns subject, has_eeg_dir, header_path, events_path, read_error, channels, sfreq, duration_s, n_annotations."""

    def of(kind: str) -> Column:
        return F.filter("channels", lambda c: channel_type(c) == kind)

    kinds = {k: of(k) for k in ("eeg", "ecg", "ppg")}
    out = headers.withColumns({f"{k}_channels": v for k, v in kinds.items()})
    no_ecg, no_ppg = F.coalesce(F.size("ecg_channels"), F.lit(0)) < 1, F.coalesce(F.size("ppg_channels"), F.lit(0)) < 1
    skip = F.when(~F.col("has_eeg_dir"), "no_eeg_dir").when(F.col("header_path").isNull(), "no_header").when(F.col("read_error").isNotNull(), F.concat(F.lit("read_error: "), F.substring("read_error", 1, 200)))
    unread = F.col("read_error").isNotNull()
    found = F.array_compact(F.array(
        F.when(F.col("events_path").isNull(), "no_events_tsv"), F.when(unread, skip), F.when(~unread & no_ecg, "no_ecg"), F.when(~unread & ~no_ecg & no_ppg, "no_ppg")))
    flags = F.when(F.col("has_eeg_dir") & F.col("header_path").isNotNull(), found).otherwise(F.array(skip))
    status = F.when(skip.isNotNull(), "skip").when(no_ecg | no_ppg, "warn").otherwise("ok")
    return out.withColumns({"status": status, "flags": flags, "n_channels": F.size("channels")}).drop("read_error", "has_eeg_dir")


def subject_sets(reg: DataFrame) -> DataFrame:
    """Which subjects are valid, have ECG, have PPG, are full, are flagged."""
    valid = F.col("status").isin("ok", "warn")
    ecg, ppg = F.size("ecg_channels") > 0, F.size("ppg_channels") > 0
    return reg.select("subject", valid.alias("valid"), (valid & ecg).alias("has_ecg"), (valid & ppg).alias("has_ppg"), (valid & ecg & ppg).alias("full"), (F.size("flags") > 0).alias("flagged"))


def mode_first_seen(df: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """A2, O3: the most frequent value of each key; of ties the one seen first."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(pos).alias("at"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("at"), F.col(value).alias("v"))).alias("m"))
    return best.select(*keys, F.col("m.v").alias("mode"), (-F.col("m.n")).alias("n"))


def frequency(df: DataFrame, col: str) -> DataFrame:
    """A1: counts of the elements of an array column, or of a column's values that are not null or zero."""
    kind = dict(df.dtypes)[col]
    items = df.select(F.explode(col).alias("value")) if kind.startswith("array") else df.where(F.col(col).isNotNull() & (F.col(col).cast("string") != "0.0")).select(F.col(col).alias("value"))
    return items.groupBy("value").agg(F.count("*").alias("n"))


def first_success(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The first value that is not null."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, order).alias(value))


def numbered(df: DataFrame, keys: list[str], order: str, width: int = 4) -> DataFrame:
    """epoch_idx from 0 and its zero-padded name. A key is one recording's events."""
    idx = F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1
    return df.withColumn("epoch_idx", idx).withColumn("epoch_key", F.lpad(F.col("epoch_idx").cast("string"), width, "0"))
