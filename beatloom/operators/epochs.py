"""Events to epochs: column resolution (F4, F5), onset rule (F6), filters (F10-F13), interval extraction (J4, J5), event files (J3), fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import classify
from ..params import LABEL_COLUMNS, ONSET_COLUMNS, Params


def resolve(df: DataFrame, candidates: tuple[str, ...]) -> str | None:
    """the first candidate among the lower-cased, trimmed column names."""
    names = {c.lower().strip(): c for c in df.columns}
    return next((names[c] for c in candidates if c in names), None)


def standard_events(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, onset double (null for n/a), label; no rows where there is no label or no onset column."""
    label, onset = resolve(df, LABEL_COLUMNS), resolve(df, ONSET_COLUMNS)
    if label is None or onset is None:
        return df.select(*keys, F.lit(None).cast("double").alias("onset"), F.lit(None).cast("string").alias("label")).where(F.lit(False))
    return df.select(*keys, F.expr(f"try_cast(`{onset}` as double)").alias("onset"), F.col(f"`{label}`").cast("string").alias("label"))


def file_events(rows: DataFrame, keys: list[str]) -> DataFrame:
    """F4, F5, F13 a file at a time: keys, onset, label from keys, fields (a map of a row's lower-cased, trimmed column names to texts).

    Each file's own columns decide; a file without an onset or a label column gives no events.
    """

    def first_of(candidates: tuple[str, ...]) -> tuple[Column, Column]:
        has = [F.map_contains_key("fields", c) for c in candidates]
        value = F.coalesce(*[F.when(h, F.struct(F.col("fields")[c].alias("v"))) for h, c in zip(has, candidates, strict=True)])
        return value["v"], value.isNotNull()

    (label, has_label), (onset, has_onset) = first_of(LABEL_COLUMNS), first_of(ONSET_COLUMNS)
    return rows.where(has_label & has_onset).select(*keys, onset.try_cast("double").alias("onset"), label.alias("label"))


def onset_sample(onset: Column, fs: float | Column, unit: str = "auto") -> Column:
    """seconds to samples, truncated toward zero; auto takes values from 10000 on for samples (Q8). Null or NaN gives null."""
    fs = fs if isinstance(fs, Column) else F.lit(float(fs))
    scaled = {"auto": F.when(onset < 1e4, onset * fs).otherwise(onset), "seconds": onset * fs, "samples": onset}[unit]
    return F.when(~F.isnan(onset), scaled.cast("long"))


def windows(events: DataFrame, p: Params, unit: str = "auto", strict: bool = True, keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    """Condition, code, is_rest, start, stop of the events whose window lies in the recording (n_samples).

    strict leaves out every subject that has an onset which is no number (Q9); otherwise only the row goes.
    """
    c = classify(F.col("label"))
    e = events.withColumn("c", c).withColumn("onset_samp", onset_sample(F.col("onset"), F.col("fs"), unit))
    if strict:
        bad = e.where(F.col("onset_samp").isNull()).select(*keys).distinct()
        e = e.join(bad, list(keys), "left_anti")
    e = e.where(F.col("onset_samp").isNotNull())
    start = F.col("onset_samp") + (F.lit(p.tmin) * F.col("fs")).cast("long")
    stop = F.col("onset_samp") + (F.lit(p.tmax) * F.col("fs")).cast("long")
    e = e.select("*", F.col("c.name").alias("condition"), F.col("c.code").alias("code"), F.col("c.is_rest").alias("is_rest"), start.alias("start"), stop.alias("stop")).drop("c")
    return e.where((F.col("start") >= 0) & (F.col("stop") <= F.col("n_samples")) & (F.col("is_rest") | (F.col("code") >= 0)))


def cut_chunked(epochs: DataFrame, chunks: DataFrame, chunk: int, keys: tuple[str, ...] = ("subject",), ids: tuple[str, ...] = ("epoch_idx",)) -> DataFrame:
    """J4 for recordings stored in chunks of a fixed number of samples, the last one shorter: equi-join on the chunk numbers that a window touches.

    A chunk's samples outside the window go before the pieces of a window are dealt out; a channel of an epoch is then in one partition.
    """
    e = epochs.withColumn("chunk_idx", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("stop") - 1) / chunk))))
    j = e.join(chunks.select(*keys, "channel", "chunk_idx", "samples"), [*keys, "chunk_idx"])
    at = F.greatest(F.col("start") - F.col("chunk_idx") * chunk, F.lit(0))
    inside = F.slice("samples", (at + 1).cast("int"), (F.col("stop") - F.col("chunk_idx") * chunk - at).cast("int"))
    pieces = j.withColumn("samples", inside).repartition(*keys, *ids, "channel")
    parts = pieces.groupBy(*keys, *ids, "start", "stop", "channel").agg(F.sort_array(F.collect_list(F.struct("chunk_idx", "samples"))).alias("p"))
    return parts.withColumn("samples", F.flatten(F.transform("p", lambda x: x["samples"]))).drop("p")


def interval_join(anchors: DataFrame, points: DataFrame, keys: list[str], at: str, start: str, stop: str, width: float) -> DataFrame:
    """J4/J5, row a sample: points in [start, stop) of their key's anchors. Both sides are dealt by key and time bucket of about a window's width, so a key with very many points is spread."""
    b = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width)))
    a = anchors.withColumn("__b", b)
    p = points.withColumn("__b", F.floor(F.col(at) / width))
    return a.join(p, [*keys, "__b"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop))).drop("__b")


def event_files(listing: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Per subject, the events file of the task and of rest, from columns subject, path; null where none is found.

    The last file in order that names the kind; else the subject's only file; else, where the other kind was found, the first file that is not
    that one; else, for the task only, events_path of the registry (subject, events_path). A folder's few files are one array.
    """
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    f = listing.where(F.endswith(name, F.lit("_events.tsv")))
    task = F.contains(name, F.lit("verbalwm"))
    g = f.groupBy("subject").agg(F.max(F.when(task, F.col("path"))).alias("t"), F.max(F.when(~task & F.contains(name, F.lit("rest")), F.col("path"))).alias("r"), F.array_sort(F.collect_list("path")).alias("all"))
    one = F.when(F.size("all") == 1, F.col("all")[0])
    first_but = lambda c: F.get(F.filter("all", lambda p: p != F.col(c)), F.lit(0))
    g = g.withColumns({"t": F.coalesce("t", one), "r": F.coalesce("r", one)})
    g = g.withColumn("t", F.coalesce("t", F.when(F.col("r").isNotNull(), first_but("r"))))
    g = g.withColumn("r", F.coalesce("r", F.when(F.col("t").isNotNull(), first_but("t"))))
    if registry is not None:
        g = g.join(registry.select("subject", "events_path"), "subject", "left").withColumn("t", F.coalesce("t", "events_path"))
    return g.select("subject", F.col("t").alias("task_file"), F.col("r").alias("rest_file"))


def with_fallback(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the second source for the keys that the first lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))
