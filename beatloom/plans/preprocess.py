"""From events and recordings to epochs and their quality table.

Recordings are chunks of a fixed number of samples, so a recording of any length is many rows, and an epoch meets only the
chunks that it touches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import discover, map_labels, normal
from ..operators import epochs as E
from ..operators import qc, registry
from ..params import Params


def chunks_of(samples: DataFrame, chunk: int, keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    """keys, channel, chunk_idx, samples from rows of keys, channel, pos, value without gaps; a list has `chunk` elements at most."""
    rows = samples.withColumn("chunk_idx", F.floor(F.col("pos") / chunk)).repartition(*keys, "chunk_idx")
    rows = rows.groupBy(*keys, "channel", "chunk_idx").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("a"))
    return rows.select(*keys, "channel", "chunk_idx", F.transform("a", lambda x: x["value"]).alias("samples"))


def discovered_labels(events: DataFrame, reg: DataFrame, most: int = 5) -> DataFrame:
    """Label, condition of the labels of the first few subjects that have events; a limit the feature has."""
    some = reg.where("status <> 'skip'").join(events.select("subject").distinct(), "subject", "left_semi").orderBy("subject").limit(most)
    labels = events.join(some.select("subject"), "subject", "left_semi").where("label IS NOT NULL").select(normal(F.col("label")).alias("label")).distinct()
    return labels.withColumn("condition", discover(F.col("label"))).where("condition IS NOT NULL")


def epoch_rows(events: DataFrame, recordings: DataFrame, label_map: DataFrame, p: Params, unit: str = "auto") -> DataFrame:
    """Subject, kind, epoch_idx, condition, label_int, onset_samp, start, stop of every epoch inside its recording.

    events: subject, onset, label; recordings: subject, fs, n_samples, one row each. Subjects that recordings lacks have no epochs
    (J2); label_int is null for rest. Epochs are numbered by start, of each kind on its own.
    """
    e = map_labels(events, label_map).withColumn("label", F.col("mapped")).join(recordings.select("subject", "fs", "n_samples"), "subject")
    w = E.windows(e, p, unit).withColumn("kind", F.when(F.col("is_rest"), "rest").otherwise("task"))
    w = registry.numbered(w.withColumn("__order", F.struct("start", "condition")), ["subject", "kind"], "__order")
    return w.select("subject", "kind", "epoch_idx", "condition", F.when(~F.col("is_rest"), F.col("code")).alias("label_int"), "onset_samp", "start", "stop")


def epochs_of_files(events: DataFrame, recordings: DataFrame, label_map: DataFrame, p: Params, unit: str = "auto") -> DataFrame:
    """J3, J9, G19 of recordings with two event files: rows as of epoch_rows().

    events: subject, file ('task' or 'rest'), onset, label; a file that serves both is there twice. Task epochs come from the task file;
    rest epochs from the rest file, and from the task file for subjects whose rest file gives none. A missing onset in a file that is read
    leaves the whole subject out (Q9); the task file is always read.
    """
    missing = E.onset_sample(F.col("onset"), 1.0, unit).isNull()
    bad = events.join(recordings.select("subject"), "subject", "left_semi").where(missing).select("subject").distinct()
    e = events.join(bad, "subject", "left_anti")
    of = {k: epoch_rows(e.where(F.col("file") == k).select("subject", "onset", "label"), recordings, label_map, p, unit) for k in ("task", "rest")}
    rest = E.with_fallback(of["rest"].where("kind = 'rest'"), of["task"].where("kind = 'rest'"), ["subject"])
    return of["task"].where("kind = 'task'").unionByName(rest)


def events_of_files(tables: DataFrame, chosen: DataFrame) -> DataFrame:
    """subject, file, onset, label: the rows of the files that event_files() chose (subject, task_file, rest_file), from subject, path, fields."""
    files = chosen.unpivot(["subject"], ["task_file", "rest_file"], "file", "path").where("path IS NOT NULL").withColumn("file", F.replace("file", F.lit("_file"), F.lit("")))
    return E.file_events(tables.join(files, ["subject", "path"]), ["subject", "file"])


def epoch_signals(rows: DataFrame, chunks: DataFrame, chunk: int) -> DataFrame:
    """Subject, kind, epoch_idx, channel and the epoch's samples."""
    floats = chunks.withColumn("samples", F.col("samples").cast("array<float>"))
    cut = E.cut_chunked(rows.select("subject", "kind", "epoch_idx", "start", "stop"), floats, chunk, ids=("kind", "epoch_idx"))
    return cut.select("subject", "kind", "epoch_idx", "channel", "samples")


def with_aux(rows: DataFrame, signals: DataFrame, aux: DataFrame) -> DataFrame:
    """K4: epochs with their ECG and PPG, zeros of the epoch's length where the recording has no such channel."""
    out = rows.join(aux, "subject", "left")
    n = (F.col("stop") - F.col("start")).cast("int")
    for kind in ("ecg", "ppg"):
        own = signals.select("subject", "kind", "epoch_idx", F.col("channel").alias(f"{kind}_channel"), F.col("samples").alias(kind))
        out = out.join(own, ["subject", "kind", "epoch_idx", f"{kind}_channel"], "left").withColumn(kind, F.coalesce(kind, F.array_repeat(F.lit(0.0).cast("float"), n)))
    return out.drop("ecg_channel", "ppg_channel")


def preprocessing_qc(reg: DataFrame, rows: DataFrame) -> DataFrame:
    """Per subject of the registry that is no skip: status, skip_reason, n_task, n_rest, conditions."""
    n = rows.groupBy("subject").agg(F.count_if(F.col("kind") == "task").alias("n_task"), F.count_if(F.col("kind") == "rest").alias("n_rest"))
    c = qc.condition_maps(rows.where("kind = 'task'"), ["subject"])
    out = reg.where("status <> 'skip'").select("subject").join(n, "subject", "left").join(c, "subject", "left").fillna(0, ["n_task", "n_rest"])
    none = F.col("n_task") == 0
    return out.select("subject", F.when(none, "skip").otherwise("success").alias("status"), F.when(none, "no task epochs").alias("skip_reason"), "n_task", "n_rest", "conditions")


def average_reference(samples: DataFrame, keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    """Each channel's samples less the mean of all channels at that place; rows without a key or a place go.

    A place is a window of a row a channel, however long a recording is, so samples are dealt out once.
    """
    at = [*keys, "pos"]
    own = samples.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in at]))
    own = own.withColumn("value", F.col("value") - F.avg("value").over(W.partitionBy(*at)))
    return own.select(*at, *[c for c in samples.columns if c not in at])


def topography(weights: DataFrame, posterior: tuple[str, ...], frontal: tuple[str, ...], keys: tuple[str, ...] = ("subject", "component"), ratio: float = 1.5) -> DataFrame:
    """Mean absolute weight over the posterior and frontal channels, 0 where there are none, and whether the first prevails."""

    def over(group: tuple[str, ...]) -> Column:
        return F.coalesce(F.avg(F.when(F.col("channel").isin(*group), F.abs("weight"))), F.lit(0.0))

    out = weights.groupBy(*keys).agg(over(posterior).alias("posterior"), over(frontal).alias("frontal"))
    return out.withColumn("keep", F.col("posterior") > ratio * F.col("frontal"))
