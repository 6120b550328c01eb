"""Quality tables: condition maps (A3), totals (A4, A5, A21, A22), file checks (F14, A25), resume (S12, A24), post-write checks (K6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import MIN_FILE_BYTES


def condition_maps(epochs: DataFrame, keys: list[str]) -> DataFrame:
    """A3: a map of condition to count; conditions are few."""
    c = epochs.groupBy(*keys, "condition").count()
    return c.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("condition", "count")))).alias("conditions"))


def totals(qc: DataFrame) -> DataFrame:
    """One row over all subjects."""
    ok = F.col("status") == "success"
    placeholders = F.coalesce(F.size(F.filter(F.map_values("channel_map"), lambda v: v["method"] == "placeholder")), F.lit(0)) if "channel_map" in qc.columns else F.lit(0)
    return qc.agg(
        F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_skip"), F.sum("n_task").alias("n_task"), F.sum("n_rest").alias("n_rest"),
        F.count_if(ok & (F.col("n_rest") > 0)).alias("with_rest"), F.count_if(ok & (F.col("n_rest") == 0)).alias("without_rest"), F.sum(placeholders).alias("n_placeholder"))


def validate_files(listing: DataFrame, extensions: tuple[str, ...] = (".vhdr", ".eeg", ".vmrk"), least: int = MIN_FILE_BYTES) -> DataFrame:
    """Per subject missing types, small signals and a verdict, from subject, path, length. The verdict goes by the first signal file in order."""
    g = listing.groupBy("subject").agg(
        *[F.count_if(F.endswith("path", F.lit(e))).alias(f"n{i}") for i, e in enumerate(extensions)],
        F.count_if(F.endswith("path", F.lit(".eeg")) & (F.col("length") < least)).alias("n_small"),
        F.min_by("length", F.when(F.endswith("path", F.lit(".eeg")), F.col("path"))).alias("first_length"))
    missing = F.array_compact(F.array(*[F.when(F.col(f"n{i}") == 0, e) for i, e in enumerate(extensions)]))
    return g.select("subject", missing.alias("missing"), "n_small", F.when(F.size(missing) > 0, "missing").when(F.col("first_length") < least, "small").otherwise("valid").alias("verdict"))


def to_fetch(remote: DataFrame, local: DataFrame) -> DataFrame:
    """What is not here at its full length; empty remote files need no fetching."""
    return remote.where("length > 0").join(local, ["path", "length"], "left_anti")


def fetch_counts(remote: DataFrame, local: DataFrame, failed: DataFrame) -> DataFrame:
    """Files fetched, skipped (here already, or empty) and failed (path), and whether none failed."""
    here = local.select("path", "length", F.lit(True).alias("here"))
    r = remote.join(here, ["path", "length"], "left").join(failed.select("path", F.lit(True).alias("bad")), "path", "left")
    skip = F.col("here").isNotNull() | (F.col("length") == 0)
    bad = ~skip & F.col("bad").isNotNull()
    out = r.agg(F.count_if(~skip & ~bad).alias("downloaded"), F.count_if(skip).alias("skipped"), F.count_if(bad).alias("failed"))
    return out.withColumn("success", F.col("failed") == 0)


def validation_summary(validity: DataFrame) -> DataFrame:
    """A row a verdict with its number of subjects and the first and last of them."""
    return validity.groupBy("verdict").agg(F.count("*").alias("n"), F.min("subject").alias("first"), F.max("subject").alias("last"))


def check_written(written: DataFrame, expected_rows: int, size: int) -> None:
    """K6: raises unless the table read back has the rows and every tensor the size."""
    r = written.agg(F.count("*").alias("n"), F.count_if(F.size("hest_norm") != size).alias("bad")).first()
    if r["n"] != expected_rows or r["bad"]:
        raise RuntimeError(f"read back {r['n']} of {expected_rows} rows, {r['bad']} of another size than {size}")
