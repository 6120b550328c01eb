"""From a folder of recordings to the subject registry and the tables behind its figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registry as R
from ..sources import recordings


def _first(found: Column) -> Column:
    """The first path, in order, of those that are found."""
    return F.min(F.when(found, F.col("path")))


def inspect(spark: SparkSession, root: str) -> DataFrame:
    """A registry row a subject folder that has any file; a subject has the first of its headers and event files.

    Contents of headers and markers are read, never samples.
    """
    files = recordings.listing(spark, root).where("subject IS NOT NULL")
    eeg = F.contains("path", F.lit("/eeg/"))
    subjects = files.groupBy("subject").agg(
        F.bool_or(eeg).alias("has_eeg_dir"), _first(eeg & F.endswith("path", F.lit(".vhdr"))).alias("header_path"),
        _first(eeg & F.endswith("path", F.lit("_events.tsv"))).alias("events_path"), _first(F.endswith("path", F.lit("_beh.tsv"))).alias("beh_path"))
    read = recordings.headers(spark, root).select("header_path", "channels", "sfreq", "duration_s", "n_annotations", "read_error")
    return R.registry(subjects.join(read, "header_path", "left"))


def _panel(name: str, rows: DataFrame, key: str, value: Column) -> DataFrame:
    return rows.select(F.lit(name).alias("panel"), F.col(key).cast("string").alias("item"), value.cast("double").alias("value"))


def panels(reg: DataFrame) -> DataFrame:
    """Panel, item, value of status, modality, sampling rate, each subject's channels by kind, durations in minutes and annotations.

    Modality: valid subjects without ECG and PPG, those with ECG and no PPG, with PPG and no ECG, and the sizes of the sets.
    """
    sets = R.subject_sets(reg)
    counted = {
        "eeg_only": F.col("valid") & ~F.col("has_ecg") & ~F.col("has_ppg"), "ecg_only": F.col("has_ecg") & ~F.col("has_ppg"), "ppg_only": F.col("has_ppg") & ~F.col("has_ecg"),
        "has_ecg": F.col("has_ecg"), "has_ppg": F.col("has_ppg"), "full": F.col("full"),
    }
    modality = sets.fillna(False, ["has_ecg", "has_ppg", "full"]).agg(*[F.count_if(x).alias(n) for n, x in counted.items()])
    modality = modality.unpivot([], modality.columns, "item", "n")
    long = reg.where("duration_s IS NOT NULL")
    kinds = reg.where("n_channels IS NOT NULL").select("subject", *[F.size(f"{a}_channels").alias(a) for a in ("eeg", "ecg", "ppg")]).unpivot(["subject"], ["eeg", "ecg", "ppg"], "kind", "n")
    out = _panel("status", reg.groupBy("status").count(), "status", F.col("count"))
    for more in (
        _panel("modality", modality, "item", F.col("n")),
        _panel("sfreq", R.frequency(reg, "sfreq"), "value", F.col("n")),
        _panel("channels", kinds.select(F.concat_ws(":", "subject", "kind").alias("item"), "n"), "item", F.col("n")),
        _panel("duration", long, "subject", F.col("duration_s") / 60),
        _panel("mean_duration", long.agg(F.lit("all").alias("k"), F.avg(F.col("duration_s") / 60).alias("m")), "k", F.col("m")),
        _panel("annotations", reg.where("n_annotations IS NOT NULL"), "subject", F.col("n_annotations")),
    ):
        out = out.unionAll(more)
    return out


def aux_variants(reg: DataFrame) -> DataFrame:
    """T5: counts of ECG and PPG channel names, each with its kind before it."""
    parts = [R.frequency(reg, f"{k}_channels").select(F.concat(F.lit(f"{k.upper()}:"), "value").alias("name"), "n") for k in ("ecg", "ppg")]
    return parts[0].unionAll(parts[1])


def aux_channels(reg: DataFrame, ecg: str = "ECG", ppg: str = "PPG") -> DataFrame:
    """each subject's ECG and PPG channel: its first one, or the name that stands for one."""
    first = lambda c, other: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(other))
    return reg.select("subject", first("ecg_channels", ecg).alias("ecg_channel"), first("ppg_channels", ppg).alias("ppg_channel"))


def sanity_check(reg: DataFrame, validity: DataFrame) -> DataFrame:
    """The first subject, in order, whose files are valid and whose header could be read, with its first eight channels."""
    good = reg.where("header_path IS NOT NULL AND status <> 'skip'").join(validity.where("verdict = 'valid'").select("subject"), "subject", "left_semi")
    return good.orderBy("subject").limit(1).select("subject", "sfreq", F.slice("channels", 1, 8).alias("channels"))
