"""The operators on the driver's tables: events as recordings (user = subject, value = sample), embeddings as epoch tensors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import arrays, kernels
from .functions.labels import channel_type, classify, discover, map_labels, normal
from .operators import channels, epochs, filters, peaks, qc, ranges, registry, windows
from .params import FRONTAL, NEIGHBOURS, POSTERIOR, PPG_FEATURES, Params
from .plans import hest, metadata, preprocess, pulse
from .sources import brainvision, recordings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LABEL_MAP = (("view", "baseline"), ("click", "sim"), ("signup", "retention_slow"), ("purchase", "retention_fastdelay"))
LABELS = ("Rest", " baseline_2s", "eyes_closed", "encoding_set_simultaneous", "all_at_once", "retention_slow", "retention_fast", "retention_fastdelay", "fd_block", "fast_delay", "slow_fast", "digit", "rest_r", "unrest", "SIM ")
CHANNELS = ("Fz", "ECG", "BIO1", "FC1", "Pulse", "Cz", "ekg2", "cp1", "bio3", "Pz", "af3", "heart_photo")
_MAP_SQL = "(VALUES ('view','baseline'),('click','sim'),('signup','retention_slow'),('purchase','retention_fastdelay')) m(l, c)"
_REST = " OR ".join(f"{{x}} = '{k}' OR starts_with({{x}}, '{k}_') OR suffix({{x}}, '_{k}')" for k in ("rest", "baseline", "resting", "fixation", "eyes_closed", "eyes_opened"))


def _class_sql(x: str) -> str:
    c = lambda p: f"contains({x}, '{p}')"
    return (
        f"CASE WHEN {_REST.format(x=x)} THEN 'rest' WHEN {c('simul')} OR {c('all_at_once')} THEN 'simultaneous' "
        f"WHEN ({c('fast')} AND ({c('delay')} OR {c('del')})) OR {c('fastdelay')} OR {c('fast_delay')} THEN 'fast_delay' "
        f"WHEN {c('slow')} AND NOT {c('fast')} THEN 'slow' WHEN {c('fast')} AND NOT ({c('delay')} OR {c('slow')}) THEN 'fast' ELSE {x} END"
    )


def query(sql: str | None = None):
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """user_id, pos (from 0), value, secs since the user's first event, label, numbered over ranges of time and stored once. A user is a recording."""
    e = t(spark, d, "events").select("user_id", F.col("event_type").alias("label"), "value", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    x = ranges.numbered(e, ["user_id"], "us", ["event_id"], "pos", "start", ranges.width(e, ["user_id"], "us"))
    return brainvision.stored(x.select("user_id", "label", "value", "pos", ((F.col("us") - F.col("start")) / 1e6).alias("secs")))


_S = """s AS (SELECT user_id, event_type AS label, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS secs FROM events)"""


CHUNK, EPOCH = 16, 1500


def epoch_arrays(spark: SparkSession, d: str) -> DataFrame:
    """user_id, epoch_idx, samples: each recording in consecutive epochs of EPOCH samples, the last one shorter."""
    s = samples(spark, d).withColumn("epoch_idx", F.floor(F.col("pos") / EPOCH).cast("int"))
    a = s.groupBy("user_id", "epoch_idx").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("a"))
    return a.select("user_id", "epoch_idx", F.transform("a", lambda v: v["value"]).alias("samples"))


def subject(c: str) -> Column:
    return F.concat(F.lit("sub-"), F.lpad(F.col(c).cast("string"), 6, "0"))


def headers(spark: SparkSession, d: str) -> DataFrame:
    """What a scan of recordings gives, a row a customer: folders, headers that are missing or bad, four channels, a rate, orders as annotations."""
    n = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    c = t(spark, d, "customer").join(n, F.col("c_custkey") == F.col("k"), "left").withColumn("subject", subject("c_custkey"))
    k, names = F.col("c_custkey"), F.array(*map(F.lit, CHANNELS))
    path = lambda end: F.concat(F.lit("/data/"), "subject", F.lit("/eeg/"), "subject", F.lit(end))
    good = (F.col("c_acctbal") >= -900) & (k % 17 != 0) & (k % 23 != 0)
    return c.select(
        "subject", (F.col("c_acctbal") >= -900).alias("has_eeg_dir"), F.when(k % 17 != 0, path(".vhdr")).alias("header_path"), F.when(F.col("n") > 0, path("_events.tsv")).alias("events_path"),
        F.when(k % 23 == 0, "ValueError: bad header").alias("read_error"),
        F.when(good, F.array(*[F.get(names, ((k * m + a) % 12).cast("int")) for m, a in ((1, 0), (5, 2), (7, 4), (11, 7))])).alias("channels"),
        F.when(good, F.element_at(F.array(F.lit(250.0), F.lit(500.0), F.lit(1000.0)), (k % 3 + 1).cast("int"))).alias("sfreq"),
        F.when(good, 60 + F.abs("c_acctbal") / 10).alias("duration_s"), F.when(good, F.coalesce("n", F.lit(0))).alias("n_annotations"))


_SUBJECT = "'sub-' || lpad(CAST({} AS VARCHAR), 6, '0')"
_KIND = "CASE WHEN regexp_matches(lower(channel), 'ecg|ekg|cardiac|heart|bio1') THEN 'ecg' WHEN regexp_matches(lower(channel), 'ppg|pleth|pulse|photo|bio2|bio3') THEN 'ppg' ELSE 'eeg' END"
_REG = f"""oc AS (SELECT o_custkey AS ok, count(*) AS n FROM orders GROUP BY 1),
rec AS (SELECT {_SUBJECT.format("c_custkey")} AS subject, c_custkey AS k, coalesce(n, 0) AS n, 60 + abs(c_acctbal) / 10 AS duration_s, CAST([250, 500, 1000][c_custkey % 3 + 1] AS DOUBLE) AS sfreq,
  CASE WHEN c_acctbal < -900 THEN 'no_eeg_dir' WHEN c_custkey % 17 = 0 THEN 'no_header' WHEN c_custkey % 23 = 0 THEN 'read_error: ValueError: bad header' END AS bad FROM customer LEFT JOIN oc ON c_custkey = ok),
ch AS (SELECT subject, i, [{', '.join(f"'{c}'" for c in CHANNELS)}][(k * m + a) % 12 + 1] AS channel FROM rec, (VALUES (0, 1, 0), (1, 5, 2), (2, 7, 4), (3, 11, 7)) v(i, m, a) WHERE bad IS NULL),
kd AS (SELECT *, {_KIND} AS kind FROM ch),
kn AS (SELECT subject, {', '.join(f"count(*) FILTER (WHERE kind = '{x}') AS n_{x}, string_agg(channel, ',' ORDER BY i) FILTER (WHERE kind = '{x}') AS {x}" for x in ("eeg", "ecg", "ppg"))} FROM kd GROUP BY 1),
reg AS (SELECT rec.*, n_eeg, n_ecg, n_ppg, eeg, ecg, ppg, CASE WHEN bad IS NOT NULL THEN 'skip' WHEN n_ecg < 1 OR n_ppg < 1 THEN 'warn' ELSE 'ok' END AS status,
  CASE WHEN bad IN ('no_eeg_dir', 'no_header') THEN bad ELSE concat_ws(',', CASE WHEN n = 0 THEN 'no_events_tsv' END, bad, CASE WHEN bad IS NOT NULL THEN NULL WHEN n_ecg < 1 THEN 'no_ecg' WHEN n_ppg < 1 THEN 'no_ppg' END) END AS flags FROM rec LEFT JOIN kn USING (subject))"""


def r6(c):
    return F.round(c, 6)


@query(f"WITH e AS (SELECT user_id, coalesce(c, event_type) AS l FROM events LEFT JOIN {_MAP_SQL} ON event_type = l) SELECT user_id, {_class_sql('l')} AS condition, count(*) AS n FROM e GROUP BY 1, 2")
def label_classify_counts(spark: SparkSession, d: str) -> DataFrame:
    """J1, F7, F8, F9, A3."""
    e = map_labels(t(spark, d, "events").select("user_id", F.col("event_type").alias("label")), spark.createDataFrame(LABEL_MAP, "label string, condition string"))
    return e.groupBy("user_id", classify(F.col("mapped"))["name"].alias("condition")).agg(F.count("*").alias("n"))


@query(f"SELECT event_id, coalesce(c, event_type) AS mapped FROM events LEFT JOIN {_MAP_SQL} ON event_type = l")
def label_map_join(spark: SparkSession, d: str) -> DataFrame:
    """J1."""
    return map_labels(t(spark, d, "events").select("event_id", F.col("event_type").alias("label")), spark.createDataFrame(LABEL_MAP, "label string, condition string")).select("event_id", "mapped")


#: Fewer keywords than discover() has: those that tell the labels above apart.
_GROUPS = (("simultaneous", ("sim", "all_at_once")), ("slow", ("slow",)), ("fast", ("fast",)), ("fast_delay", ("fd", "delay_fast")))


@query(f"WITH l AS (SELECT DISTINCT lower(trim(CAST([{', '.join(f"'{x}'" for x in LABELS)}][(event_id * 7 + user_id) % {len(LABELS)} + 1] AS VARCHAR))) AS label FROM events) SELECT label, CASE WHEN {_REST.format(x='label')} THEN 'rest' " + " ".join(f"WHEN {' OR '.join(f"contains(label, '{k}')" for k in keys)} THEN '{n}'" for n, keys in _GROUPS) + " END AS found FROM l")
def label_discovery(spark: SparkSession, d: str) -> DataFrame:
    """A label for each event, by its ids."""
    e = t(spark, d, "events").select(F.element_at(F.array(*map(F.lit, LABELS)), ((F.col("event_id") * 7 + F.col("user_id")) % len(LABELS) + 1).cast("int")).alias("label"))
    return e.select(normal(F.col("label")).alias("label")).distinct().select("label", discover(F.col("label")).alias("found"))


@query(f"WITH {_REG}, e AS (SELECT {_SUBJECT.format('user_id')} AS subject, lower(event_type) AS label FROM events), f AS (SELECT DISTINCT subject FROM e JOIN reg USING (subject) WHERE status <> 'skip' ORDER BY subject LIMIT 5), l AS (SELECT DISTINCT label || CASE WHEN label = 'click' THEN '_slow' WHEN label = 'view' THEN '_rest' WHEN label = 'error' THEN '_fast_delay' ELSE '' END AS label FROM e JOIN f USING (subject)) SELECT label, CASE WHEN label = 'view_rest' THEN 'rest' WHEN label = 'click_slow' THEN 'slow' ELSE 'fast' END AS condition FROM l WHERE contains(label, '_')")
def first_subjects_labels(spark: SparkSession, d: str) -> DataFrame:
    """The first five subjects' labels."""
    end = F.when(F.col("event_type") == "click", "_slow").when(F.col("event_type") == "view", "_rest").when(F.col("event_type") == "error", "_fast_delay").otherwise("")
    e = t(spark, d, "events").select(subject("user_id").alias("subject"), F.concat(F.upper("event_type"), end, F.lit(" ")).alias("label"))
    return preprocess.discovered_labels(e, registry.registry(headers(spark, d)))


@query(f"WITH {_S} SELECT user_id, pos, CAST(trunc(CASE WHEN secs < 1e4 THEN secs * 250 ELSE secs END) AS BIGINT) AS auto_samp, CAST(trunc(secs * 250) AS BIGINT) AS sec_samp FROM s")
def onset_to_sample(spark: SparkSession, d: str) -> DataFrame:
    """F6."""
    return samples(spark, d).select("user_id", "pos", epochs.onset_sample(F.col("secs"), 250.0).alias("auto_samp"), epochs.onset_sample(F.col("secs"), 250.0, "seconds").alias("sec_samp"))


@query(f"WITH {_S}, c AS (SELECT user_id, label, count(*) AS n, min(pos) AS seen FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) AS k FROM c) SELECT user_id, label AS mode, n FROM r WHERE k = 1")
def mode_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """A2, O3."""
    return registry.mode_first_seen(samples(spark, d), ["user_id"], "label", "pos")


def registry_of(spark: SparkSession, d: str) -> DataFrame:
    return registry.registry(headers(spark, d))


@query(f"WITH {_REG} SELECT subject, status, flags, coalesce(eeg, '') AS eeg, coalesce(ecg, '') AS ecg, coalesce(ppg, '') AS ppg, CAST(CASE WHEN bad IS NULL THEN 4 ELSE 0 END AS INT) AS n_channels, CASE WHEN bad IS NULL THEN n ELSE 0 END AS n_annotations FROM reg")
def registry_table(spark: SparkSession, d: str) -> DataFrame:
    """F1, F2, F16, G20, A23, Q18."""
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c.removesuffix("_channels"))
    return registry_of(spark, d).select("subject", "status", text("flags"), *[text(f"{k}_channels") for k in ("eeg", "ecg", "ppg")], F.coalesce("n_channels", F.lit(0)).alias("n_channels"), F.coalesce("n_annotations", F.lit(0)).alias("n_annotations"))


@query(f"WITH {_REG} SELECT subject, status <> 'skip' AS valid, coalesce(status <> 'skip' AND n_ecg > 0, false) AS has_ecg, coalesce(status <> 'skip' AND n_ppg > 0, false) AS has_ppg, coalesce(status <> 'skip' AND n_ecg > 0 AND n_ppg > 0, false) AS full, flags <> '' AS flagged FROM reg")
def subject_sets(spark: SparkSession, d: str) -> DataFrame:
    """F3, J8, T4, T7."""
    s = registry.subject_sets(registry_of(spark, d))
    return s.select("subject", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("valid", "has_ecg", "has_ppg", "full", "flagged")])


@query(f"WITH {_REG} SELECT channel AS value, count(*) AS n FROM ch GROUP BY 1")
def channel_name_counts(spark: SparkSession, d: str) -> DataFrame:
    """A1."""
    return registry.frequency(registry_of(spark, d), "channels")


@query(f"WITH {_REG}, f AS (SELECT sfreq, count(*) AS n, min(subject) AS seen FROM reg WHERE bad IS NULL GROUP BY 1) SELECT sfreq AS mode, n FROM f ORDER BY n DESC, seen LIMIT 1")
def cohort_rate(spark: SparkSession, d: str) -> DataFrame:
    """A2, O3: the most frequent rate, of ties the one of the first subject."""
    return registry.mode_first_seen(registry_of(spark, d).withColumn("all", F.lit(1)), ["all"], "sfreq", "subject").select("mode", "n")


@query(f"""WITH {_REG}, ok AS (SELECT subject FROM reg WHERE status IN ('ok', 'warn')), he AS (SELECT DISTINCT subject FROM kd WHERE kind = 'ecg'), hp AS (SELECT DISTINCT subject FROM kd WHERE kind = 'ppg')
SELECT 'status' AS panel, status AS item, CAST(count(*) AS DOUBLE) AS value FROM reg GROUP BY status
UNION ALL SELECT 'modality', 'eeg_only', count(*) FROM ok WHERE subject NOT IN (SELECT subject FROM he) AND subject NOT IN (SELECT subject FROM hp)
UNION ALL SELECT 'modality', 'ecg_only', count(*) FROM he WHERE subject NOT IN (SELECT subject FROM hp)
UNION ALL SELECT 'modality', 'ppg_only', count(*) FROM hp WHERE subject NOT IN (SELECT subject FROM he)
UNION ALL SELECT 'modality', 'has_ecg', count(*) FROM he UNION ALL SELECT 'modality', 'has_ppg', count(*) FROM hp
UNION ALL SELECT 'modality', 'full', count(*) FROM ok WHERE subject IN (SELECT subject FROM he) AND subject IN (SELECT subject FROM hp)
UNION ALL SELECT 'sfreq', CAST(sfreq AS VARCHAR), count(*) FROM reg WHERE bad IS NULL GROUP BY sfreq
UNION ALL SELECT 'channels', subject || ':' || c, (SELECT count(*) FROM kd WHERE kd.subject = r.subject AND kind = c) FROM reg r, (VALUES ('eeg'), ('ecg'), ('ppg')) x(c) WHERE bad IS NULL
UNION ALL SELECT 'duration', subject, round(duration_s / 60, 6) FROM reg WHERE bad IS NULL
UNION ALL SELECT 'mean_duration', 'all', round(avg(duration_s / 60), 6) FROM reg WHERE bad IS NULL
UNION ALL SELECT 'annotations', subject, n FROM reg WHERE bad IS NULL""")
def metadata_panels(spark: SparkSession, d: str) -> DataFrame:
    """K9, 2.6, A19, A20, A23."""
    return metadata.panels(registry_of(spark, d)).withColumn("value", r6(F.col("value")))


@query(f"WITH {_REG} SELECT upper(kind) || ':' || channel AS name, count(*) AS n FROM kd WHERE kind <> 'eeg' GROUP BY 1")
def aux_name_variants(spark: SparkSession, d: str) -> DataFrame:
    """T5, 2.6."""
    return metadata.aux_variants(registry_of(spark, d))


@query(f"WITH {_REG} SELECT subject, coalesce(split_part(ecg, ',', 1), 'ECG') AS ecg_channel, coalesce(split_part(ppg, ',', 1), 'PPG') AS ppg_channel FROM reg")
def aux_channel_choice(spark: SparkSession, d: str) -> DataFrame:
    """F18."""
    return metadata.aux_channels(registry_of(spark, d))


@query(f"WITH {_REG} SELECT subject, CAST(i AS INT) AS ch_pos, channel, kind FROM kd")
def channel_kinds(spark: SparkSession, d: str) -> DataFrame:
    """F1, F17."""
    c = headers(spark, d).select("subject", F.posexplode("channels").alias("ch_pos", "channel"))
    return c.withColumn("kind", channel_type(F.col("channel")))


@query("WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error') SELECT 'only_a' AS part, count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'both', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)")
def modality_sets(spark: SparkSession, d: str) -> DataFrame:
    """J8, T1, T4, T7 as set operations."""
    e = t(spark, d, "events")
    a, b = (e.where(F.col("event_type") == k).select("user_id").distinct() for k in ("purchase", "error"))
    parts = {"only_a": a.join(b, "user_id", "left_anti"), "both": a.intersect(b), "either": a.union(b).distinct()}
    out = [x.agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k, x in parts.items()]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query(f"WITH {_S} SELECT a.user_id, a.pos, count(*) AS n, round(sum(b.value), 6) AS total FROM s a JOIN s b ON a.user_id = b.user_id AND b.secs >= a.secs AND b.secs < a.secs + 172800 WHERE a.label = 'signup' GROUP BY 1, 2")
def interval_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Two-day windows after each anchor; windows may overlap."""
    s = samples(spark, d)
    a = s.where("label = 'signup'").select("user_id", "pos", F.col("secs").alias("start"), (F.col("secs") + 172800).alias("stop"))
    j = epochs.interval_join(a, s.select("user_id", "secs", "value"), ["user_id"], "secs", "start", "stop", 172800.0)
    return j.groupBy("user_id", "pos").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


_CODE = "CASE name WHEN 'simultaneous' THEN 0 WHEN 'slow' THEN 1 WHEN 'fast' THEN 2 WHEN 'fast_delay' THEN 3 ELSE -1 END"
_EPOCHS = f"""{_REG}, {_S}, nn AS (SELECT user_id, count(*) AS n_samples, bool_or(pos % 61 = 60) AS broken FROM s GROUP BY 1),
m AS (SELECT s.*, n_samples, {_SUBJECT.format("s.user_id")} AS subject, coalesce(c, label) AS lab FROM s JOIN nn USING (user_id) LEFT JOIN {_MAP_SQL} ON label = l WHERE NOT broken),
k AS (SELECT *, {_class_sql("lab")} AS name FROM m), w AS (SELECT *, name = 'rest' AS is_rest, {_CODE} AS code, pos - 2 AS start, pos + 6 AS stop FROM k),
ep AS (SELECT w.*, row_number() OVER (PARTITION BY w.subject, is_rest ORDER BY start, name) - 1 AS epoch_idx FROM w JOIN reg ON w.subject = reg.subject AND status <> 'skip' WHERE start >= 0 AND stop <= n_samples AND (is_rest OR code >= 0))"""


def event_rows(spark: SparkSession, d: str) -> DataFrame:
    """subject, onset, label, as an event file has them: columns by other names, places as text, one in 61 of them missing."""
    s = samples(spark, d)
    onset = F.when(F.col("pos") % 61 == 60, "n/a").otherwise(F.col("pos").cast("string"))
    raw = s.select(subject("user_id").alias("subject"), onset.alias(" Onset "), F.col("label").alias("Trial_Type"), F.col("value").cast("string").alias("value"))
    return epochs.standard_events(raw, ["subject"])


def recorded(spark: SparkSession, d: str) -> DataFrame:
    """subject, fs, n_samples of the users that the registry does not skip; counting them needs no order."""
    rec = t(spark, d, "events").groupBy(subject("user_id").alias("subject")).agg(F.lit(1.0).alias("fs"), F.count("*").alias("n_samples"))
    return rec.join(registry_of(spark, d).where("status <> 'skip'").select("subject"), "subject")


def epoch_table(spark: SparkSession, d: str) -> DataFrame:
    label_map = spark.createDataFrame(LABEL_MAP, "label string, condition string")
    return preprocess.epoch_rows(event_rows(spark, d), recorded(spark, d), label_map, Params(fs=1.0, tmin=-2.0, tmax=6.0))


@query(f"""WITH {_EPOCHS}, v AS (SELECT w.*, CASE WHEN pos % 9 = 0 THEN 'rest' ELSE 'task' END AS file FROM w JOIN reg ON w.subject = reg.subject AND status <> 'skip' WHERE start >= 0 AND stop <= n_samples AND (is_rest OR code >= 0)),
own AS (SELECT * FROM v WHERE is_rest AND file = 'rest'), al AS (SELECT * FROM v WHERE NOT is_rest AND file = 'task' UNION ALL SELECT * FROM own UNION ALL SELECT * FROM v WHERE is_rest AND file = 'task' AND subject NOT IN (SELECT subject FROM own))
SELECT subject, CASE WHEN is_rest THEN 'rest' ELSE 'task' END AS kind, CAST(row_number() OVER (PARTITION BY subject, is_rest ORDER BY start, name) - 1 AS INT) AS epoch_idx, name AS condition, CAST(CASE WHEN NOT is_rest THEN code ELSE -1 END AS INT) AS label_int, CAST(pos AS BIGINT) AS onset_samp FROM al""")
def two_file_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Every ninth event of a recording is in its rest file, the others in its task file; rest epochs fall back to the latter."""
    e = event_rows(spark, d).withColumn("file", F.when(F.col("onset") % 9 == 0, "rest").otherwise("task"))
    rows = preprocess.epochs_of_files(e, recorded(spark, d), spark.createDataFrame(LABEL_MAP, "label string, condition string"), Params(fs=1.0, tmin=-2.0, tmax=6.0))
    return rows.select("subject", "kind", "epoch_idx", "condition", F.coalesce("label_int", F.lit(-1)).alias("label_int"), "onset_samp")


def recording_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Channels of each recording in chunks: its values, their negatives and their doubles."""
    s = samples(spark, d).select(subject("user_id").alias("subject"), "pos", "value")
    both = s.select("subject", "pos", F.explode(F.create_map(F.lit("ECG"), F.col("value"), F.lit("Fz"), -F.col("value"), F.lit("Pulse"), 2 * F.col("value"))).alias("channel", "value"))
    return preprocess.chunks_of(both, CHUNK)


@query(f"WITH {_EPOCHS} SELECT subject, CASE WHEN is_rest THEN 'rest' ELSE 'task' END AS kind, CAST(epoch_idx AS INT) AS epoch_idx, name AS condition, CAST(CASE WHEN NOT is_rest THEN code ELSE -1 END AS INT) AS label_int, CAST(pos AS BIGINT) AS onset_samp, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM ep")
def epoch_rows(spark: SparkSession, d: str) -> DataFrame:
    """F4-F13, J1, J2, W7, Q9 (a subject with a missing onset has no epochs)."""
    return epoch_table(spark, d).fillna(-1, ["label_int"])


@query(f"WITH {_EPOCHS} SELECT ep.subject, CASE WHEN is_rest THEN 'rest' ELSE 'task' END AS kind, CAST(epoch_idx AS INT) AS epoch_idx, c.channel, count(*) AS n, round(sum(b.value * sign), 3) AS total, round(min(b.value * sign), 3) AS low FROM ep JOIN s b ON b.user_id = ep.user_id AND b.pos >= ep.start AND b.pos < ep.stop, (VALUES ('ECG', 1), ('Fz', -1), ('Pulse', 2)) c(channel, sign) GROUP BY 1, 2, 3, 4")
def epoch_slices(spark: SparkSession, d: str) -> DataFrame:
    """J4 over chunks, F12, F19, Q26: each epoch's samples of each channel."""
    x = preprocess.epoch_signals(epoch_table(spark, d), recording_chunks(spark, d), CHUNK)
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v)
    return x.select("subject", "kind", "epoch_idx", "channel", F.size("samples").cast("long").alias("n"), F.round(total, 3).alias("total"), F.round(F.array_min("samples").cast("double"), 3).alias("low"))


@query(f"WITH {_EPOCHS} SELECT ep.subject, CASE WHEN is_rest THEN 'rest' ELSE 'task' END AS kind, CAST(epoch_idx AS INT) AS epoch_idx, round(CASE WHEN coalesce(split_part(reg.ecg, ',', 1), 'ECG') = 'ECG' THEN sum(b.value) ELSE 0 END, 3) AS ecg_total, round(CASE WHEN split_part(reg.ppg, ',', 1) = 'Pulse' THEN sum(2 * b.value) ELSE 0 END, 3) AS ppg_total, count(*) AS n FROM ep JOIN reg ON ep.subject = reg.subject JOIN s b ON b.user_id = ep.user_id AND b.pos >= ep.start AND b.pos < ep.stop GROUP BY 1, 2, 3, reg.ecg, reg.ppg")
def epoch_aux_signals(spark: SparkSession, d: str) -> DataFrame:
    """ECG and PPG of each epoch, zeros where the recording lacks the channel that the registry names."""
    rows = brainvision.stored(epoch_table(spark, d))
    x = preprocess.with_aux(rows, preprocess.epoch_signals(rows, recording_chunks(spark, d), CHUNK), metadata.aux_channels(registry_of(spark, d)))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), 3)
    return x.select("subject", "kind", "epoch_idx", total("ecg").alias("ecg_total"), total("ppg").alias("ppg_total"), F.size("ppg").cast("long").alias("n"))


_QC = f"""{_EPOCHS}, e2 AS (SELECT subject, count(*) FILTER (WHERE NOT is_rest) AS nt, count(*) FILTER (WHERE is_rest) AS nr FROM ep GROUP BY 1),
e3 AS (SELECT subject, string_agg(name || '=' || n, ',' ORDER BY name) AS conditions FROM (SELECT subject, name, count(*) AS n FROM ep WHERE NOT is_rest GROUP BY 1, 2) GROUP BY 1),
qc AS (SELECT reg.subject, CASE WHEN coalesce(nt, 0) = 0 THEN 'skip' ELSE 'success' END AS status, CASE WHEN coalesce(nt, 0) = 0 THEN 'no task epochs' END AS skip_reason, coalesce(nt, 0) AS n_task, coalesce(nr, 0) AS n_rest, conditions FROM reg LEFT JOIN e2 USING (subject) LEFT JOIN e3 USING (subject) WHERE reg.status <> 'skip')"""


@query(f"WITH {_QC} SELECT * FROM qc")
def preprocessing_qc(spark: SparkSession, d: str) -> DataFrame:
    """A3, A5, K7, K10."""
    q = preprocess.preprocessing_qc(registry_of(spark, d), epoch_table(spark, d))
    return q.withColumn("conditions", F.array_join(F.transform(F.map_entries("conditions"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


@query(f"WITH {_QC} SELECT count(*) FILTER (WHERE status = 'success') AS n_ok, count(*) FILTER (WHERE status <> 'success') AS n_skip, CAST(sum(n_task) AS BIGINT) AS n_task, CAST(sum(n_rest) AS BIGINT) AS n_rest, count(*) FILTER (WHERE status = 'success' AND n_rest > 0) AS with_rest, count(*) FILTER (WHERE status = 'success' AND n_rest = 0) AS without_rest, CAST(0 AS BIGINT) AS n_placeholder FROM qc")
def qc_totals(spark: SparkSession, d: str) -> DataFrame:
    """A5, A21, K10."""
    return qc.totals(preprocess.preprocessing_qc(registry_of(spark, d), epoch_table(spark, d)))


@query(f"WITH {_S} SELECT user_id, pos, round(secs - lag(secs) OVER (PARTITION BY user_id ORDER BY pos), 6) AS rr FROM s")
def rr_diff(spark: SparkSession, d: str) -> DataFrame:
    """W1."""
    return windows.diff(samples(spark, d), ["user_id"], "pos", "secs").select("user_id", "pos", r6(F.col("rr")).alias("rr"))


@query(f"WITH {_S}, r AS (SELECT *, secs - lag(secs) OVER (PARTITION BY user_id ORDER BY pos) AS rr FROM s), m AS (SELECT *, median(rr) OVER (PARTITION BY user_id) AS md, count(*) OVER (PARTITION BY user_id) AS c FROM r), k AS (SELECT * FROM m WHERE c < 3 OR rr IS NULL OR abs(rr - md) < 0.3 * md) SELECT user_id, pos, round(secs - lag(secs) OVER (PARTITION BY user_id ORDER BY pos), 6) AS rr FROM k")
def rr_clean(spark: SparkSession, d: str) -> DataFrame:
    """W2, A11, G8, Q11."""
    return windows.clean_beats(samples(spark, d), ["user_id"], "pos", "secs").select("user_id", "pos", r6(F.col("rr")).alias("rr"))


@query(f"WITH {_S} SELECT user_id, pos, round(sum(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7, 6) AS smooth FROM s")
def moving_avg_zero_pad(spark: SparkSession, d: str) -> DataFrame:
    """W3."""
    return windows.moving_average(samples(spark, d), ["user_id"], "pos", "value", 7).select("user_id", "pos", r6(F.col("smooth")).alias("smooth"))


_MAXIMA = "p AS (SELECT * FROM (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos)) WHERE value > a AND value > b)"


@query(f"WITH {_S}, {_MAXIMA} SELECT user_id, pos FROM p")
def local_maxima(spark: SparkSession, d: str) -> DataFrame:
    """G9, first part."""
    return windows.local_maxima(samples(spark, d), ["user_id"], "pos", "value").select("user_id", "pos")


@query(f"""WITH RECURSIVE {_S}, r AS (SELECT user_id, pos, value, lag(value) OVER (PARTITION BY user_id ORDER BY pos) AS pv FROM s WHERE value IS NOT NULL), st AS (SELECT * FROM r WHERE pv IS NULL OR pv <> value),
u AS (SELECT user_id, (pos + e - 1) // 2 AS pos, value FROM (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b, lead(pos) OVER w AS e FROM st WINDOW w AS (PARTITION BY user_id ORDER BY pos)) WHERE value > a AND value > b),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, pos DESC) AS rk FROM u),
g AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rk, CAST([] AS BIGINT[]) AS kept FROM k UNION ALL SELECT g.user_id, k.rk, CASE WHEN len([x FOR x IN kept IF abs(x - k.pos) < 4]) = 0 THEN list_append(kept, k.pos) ELSE kept END FROM g JOIN k ON k.user_id = g.user_id AND k.rk = g.rk + 1),
m AS (SELECT user_id, pos, value FROM (SELECT user_id, unnest(kept) AS pos FROM (SELECT user_id, arg_max(kept, rk) AS kept FROM g GROUP BY 1)) JOIN k USING (user_id, pos)),
h AS (SELECT m.user_id, m.pos, m.value, coalesce(max(s.pos) FILTER (WHERE s.value > m.value AND s.pos < m.pos), -1) AS lo, coalesce(min(s.pos) FILTER (WHERE s.value > m.value AND s.pos > m.pos), 9e18) AS hi FROM m JOIN s USING (user_id) GROUP BY 1, 2, 3),
f AS (SELECT h.user_id, h.pos, h.value - greatest(min(s.value) FILTER (WHERE s.pos > lo AND s.pos <= h.pos), min(s.value) FILTER (WHERE s.pos >= h.pos AND s.pos < hi)) AS p FROM h JOIN s ON s.user_id = h.user_id GROUP BY h.user_id, h.pos, h.value)
SELECT user_id, CAST(pos AS BIGINT) AS pos, round(p, 6) AS prominence FROM f WHERE p >= 20""")
def prominent_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Of each recording, the peaks four samples apart that stand out by 20."""
    x = peaks.find(samples(spark, d), ["user_id"], 4)
    return x.where("prominence >= 20").select("user_id", "pos", r6(F.col("prominence")).alias("prominence"))


@query(f"WITH {_S}, {_MAXIMA}, g AS (SELECT user_id, pos, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) AS stop FROM p), k AS (SELECT * FROM g WHERE stop - pos >= 3), v AS (SELECT k.user_id, k.pos, k.stop, s.pos AS i, s.value, s.value + lead(s.value) OVER (PARTITION BY k.user_id, k.pos ORDER BY s.pos) AS pair FROM k JOIN s ON s.user_id = k.user_id AND s.pos >= k.pos AND s.pos < k.stop), z AS (SELECT *, min(value) OVER q AS lo, max(value) OVER q AS hi FROM v WINDOW q AS (PARTITION BY user_id, pos)) SELECT user_id, pos, stop, round(max(hi) - max(lo), 4) AS amp, round((arg_min(i, (-value, i)) - pos) / 20.0 * 1000, 4) AS rise, round((max(i) FILTER (WHERE value >= lo + (hi - lo) / 2) - min(i) FILTER (WHERE value >= lo + (hi - lo) / 2)) / 20.0 * 1000, 4) AS width, round(sum(pair) / 40.0, 6) AS area FROM z GROUP BY user_id, pos, stop")
def pulse_segments(spark: SparkSession, d: str) -> DataFrame:
    """The shape of each pulse between peaks, at 20 Hz."""
    s = samples(spark, d)
    x = pulse.pulses(s, windows.local_maxima(s, ["user_id"], "pos", "value"), ["user_id"], 20.0, 3)
    return x.select("user_id", "pos", "stop", *[F.round(c, 6 if c == "area" else 4).alias(c) for c in ("amp", "rise", "width", "area")])


@query(f"""WITH {_S}, {_MAXIMA}, i0 AS (SELECT user_id, pos, row_number() OVER w - 2 AS t, (pos - lag(pos) OVER w) / 20.0 * 1000 AS ibi, lead(pos) OVER w AS stop FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
i1 AS (SELECT *, ibi - lag(ibi) OVER (PARTITION BY user_id ORDER BY pos) AS d1 FROM i0),
i2 AS (SELECT user_id, avg(ibi) AS m, max(ibi) - min(ibi) AS r, regr_slope(ibi, t) AS sl, regr_syy(ibi, t) AS yy, regr_sxy(ibi, t) AS xy, stddev_pop(ibi) AS sd, avg(d1) AS d1, count(*) AS n FROM i1 GROUP BY 1 HAVING count(*) >= 3),
v AS (SELECT k.user_id, k.pos, s.pos AS i, s.value, s.value + lead(s.value) OVER (PARTITION BY k.user_id, k.pos ORDER BY s.pos) AS pair FROM i0 k JOIN s ON s.user_id = k.user_id AND s.pos >= k.pos AND s.pos < k.stop WHERE k.stop - k.pos >= 5),
z AS (SELECT *, min(value) OVER q AS lo, max(value) OVER q AS hi FROM v WINDOW q AS (PARTITION BY user_id, pos)),
u AS (SELECT user_id, pos, max(hi) - max(lo) AS amp, (arg_min(i, (-value, i)) - pos) / 20.0 * 1000 AS rise, (max(i) FILTER (WHERE value >= lo + (hi - lo) / 2) - min(i) FILTER (WHERE value >= lo + (hi - lo) / 2)) / 20.0 * 1000 AS width, sum(pair) / 40.0 AS area FROM z GROUP BY 1, 2),
g AS (SELECT user_id, avg(amp) AS am, var_pop(amp) AS av, avg(rise) AS rm, avg(width) AS wm, avg(area) AS arm, var_pop(area) AS arv FROM u GROUP BY 1)
SELECT a.user_id, round(coalesce(m, 0) + 1e-9, 4) AS ibi_mean, round(coalesce(r, 0) + 1e-9, 4) AS ibi_range, round(coalesce(sl, 0) + 1e-9, 4) AS ibi_slope, round(coalesce(1 - greatest(yy - sl * xy, 0) / (yy + 1e-8), 0) + 1e-9, 4) AS ibi_r2, round(coalesce(sd / (m + 1e-8), 0) + 1e-9, 4) AS ibi_samp_en, round(coalesce(d1, 0) + 1e-9, 4) AS ibi_d1_mean,
  round(coalesce(am, 0) + 1e-9, 4) AS ppg_amp_mean, round(coalesce(av, 0) + 1e-9, 3) AS ppg_amp_var, round(coalesce(rm, 0) + 1e-9, 4) AS ppg_rise_mean, round(coalesce(wm, 0) + 1e-9, 4) AS ppg_width_mean, round(coalesce(arm, 0) + 1e-9, 4) AS ppg_area_mean, round(coalesce(arv, 0) + 1e-9, 4) AS ppg_area_var
FROM (SELECT DISTINCT user_id FROM s) a LEFT JOIN i2 USING (user_id) LEFT JOIN g USING (user_id)""")
def pulse_features(spark: SparkSession, d: str) -> DataFrame:
    """G15 after the choice of peaks, A12-A16: each recording at 20 Hz, its local maxima as peaks."""
    s = samples(spark, d)
    x = pulse.features(s, windows.local_maxima(s, ["user_id"], "pos", "value"), ["user_id"], 20.0)
    return x.select("user_id", *[F.round(F.col(c) + 1e-9, 3 if c == "ppg_amp_var" else 4).alias(c) for c in PPG_FEATURES])


@query(f"WITH {_S}, {_MAXIMA} SELECT p.user_id, p.pos AS peak, arg_min(s.pos, (-s.value, s.pos)) AS refined FROM p JOIN s ON s.user_id = p.user_id AND s.pos >= p.pos - 4 AND s.pos < p.pos + 4 GROUP BY 1, 2")
def refined_peaks(spark: SparkSession, d: str) -> DataFrame:
    """W5, G7 last part: the highest sample near each peak."""
    s = samples(spark, d)
    found = windows.local_maxima(s, ["user_id"], "pos", "value").select("user_id", F.col("pos").alias("peak"))
    return windows.refine(found, s.select("user_id", "pos", "value"), ["user_id"], 4)


@query("WITH c AS (SELECT l_orderkey AS subject, l_linenumber AS channel, l_partkey % 3 AS pos, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3), m AS (SELECT subject, pos, avg(value) AS m FROM c GROUP BY 1, 2) SELECT subject, channel, CAST(pos AS BIGINT) AS pos, round(value - m, 6) AS value FROM c JOIN m USING (subject, pos)")
def average_reference(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as channels, three places."""
    c = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("subject"), F.col("l_linenumber").alias("channel"), (F.col("l_partkey") % 3).alias("pos")).agg(F.sum("l_quantity").alias("value"))
    return preprocess.average_reference(c).select("subject", "channel", "pos", r6(F.col("value")).alias("value"))


_SITES = ("O1", "Pz", "Fz", "Cz", "T7", "P3", "F4")


@query(f"WITH w AS (SELECT l_suppkey AS subject, l_linenumber AS component, [{', '.join(f"'{x}'" for x in _SITES)}][l_partkey % 7 + 1] AS channel, l_quantity - 25 AS weight FROM lineitem), g AS (SELECT subject, component, coalesce(avg(abs(weight)) FILTER (WHERE channel IN ('O1', 'Pz', 'P3')), 0) AS p, coalesce(avg(abs(weight)) FILTER (WHERE channel IN ('Fz', 'Cz', 'F4')), 0) AS f FROM w GROUP BY 1, 2) SELECT subject, component, round(p, 6) AS posterior, round(f, 6) AS frontal, p > 1.5 * f AS keep FROM g")
def component_topography(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as weights of components."""
    site = F.element_at(F.array(*map(F.lit, _SITES)), (F.col("l_partkey") % 7 + 1).cast("int"))
    w = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("subject"), F.col("l_linenumber").alias("component"), site.alias("channel"), (F.col("l_quantity") - 25).alias("weight"))
    x = preprocess.topography(w, POSTERIOR, FRONTAL)
    return x.select("subject", "component", r6(F.col("posterior")).alias("posterior"), r6(F.col("frontal")).alias("frontal"), "keep")


@query(f"WITH {_S}, g AS (SELECT user_id, regr_slope(value, pos) AS sl, regr_intercept(value, pos) AS ic, regr_syy(value, pos) AS yy, regr_sxy(value, pos) AS xy, avg(value) AS m, max(value) - min(value) AS r, stddev_pop(value) AS sd, var_pop(value) AS v FROM s GROUP BY 1) SELECT user_id, round(sl, 6) AS slope, round(ic, 6) AS intercept, round(1 - greatest(yy - sl * xy, 0) / (yy + 1e-8), 6) AS r2, round(m, 6) AS mean, round(r, 6) AS range, round(v, 4) AS var, round(sd / (m + 1e-8), 6) AS cv FROM g")
def trend_slope_r2(spark: SparkSession, d: str) -> DataFrame:
    """A12-A14, Q12."""
    x = windows.trend(samples(spark, d), ["user_id"], "pos", "value")
    return x.select("user_id", *[r6(F.col(c)).alias(c) for c in ("slope", "intercept", "r2", "mean", "range", "cv")], F.round("var", 4).alias("var"))


@query(f"WITH {_S}, r AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY pos) AS dv FROM s) SELECT user_id, round(avg(dv), 6) AS d1_mean FROM r GROUP BY 1")
def mean_first_difference(spark: SparkSession, d: str) -> DataFrame:
    """A15."""
    return windows.diff(samples(spark, d), ["user_id"], "pos", "value", "dv").groupBy("user_id").agg(r6(F.avg("dv")).alias("d1_mean"))


_EMB = "e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


@query(f"WITH {_EMB} SELECT label, CAST(pos AS INT) AS pos, round(avg(v), 6) AS mean, round(stddev_pop(v) + 1e-8, 6) AS std FROM e GROUP BY 1, 2")
def tensor_group_mean_std(spark: SparkSession, d: str) -> DataFrame:
    """A8, A9."""
    s = arrays.array_stats(t(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("x")), ["label"], "x")
    z = s.select("label", F.posexplode(F.arrays_zip("mean", "std")).alias("pos", "z"))
    return z.select("label", "pos", r6(F.col("z.mean")).alias("mean"), r6(F.col("z.std")).alias("std"))


@query(f"WITH {_EMB}, r AS (SELECT pos, avg(v) AS m, stddev_pop(v) + 1e-8 AS s FROM e WHERE label = 0 GROUP BY 1) SELECT vec_id, CAST(pos AS INT) AS pos, round((v - m) / s, 4) AS z FROM e JOIN r USING (pos) WHERE label <> 0")
def rest_zscore(spark: SparkSession, d: str) -> DataFrame:
    """Label 0 is rest."""
    e = t(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"), F.lit(0).alias("g"))
    rest = arrays.array_stats(e.where("label = 0"), ["g"], "x")
    z = e.where("label <> 0").join(rest, "g", "left").select("vec_id", F.posexplode(arrays.zscore(F.col("x"), F.col("mean"), F.col("std"))).alias("pos", "z"))
    return z.select("vec_id", "pos", F.round("z", 4).alias("z"))


@query(f"WITH {_EMB} SELECT vec_id, CAST(pos // 5 AS INT) AS pos, round(v, 6) AS v FROM e WHERE pos % 5 = 0")
def decimate(spark: SparkSession, d: str) -> DataFrame:
    """W6."""
    x = t(spark, d, "embeddings").select("vec_id", F.posexplode(arrays.decimate(F.col("embedding").cast("array<double>"))).alias("pos", "v"))
    return x.select("vec_id", "pos", r6(F.col("v")).alias("v"))


@query(f"WITH {_S}, n AS (SELECT DISTINCT user_id FROM s), g AS (SELECT user_id, unnest(range(60)) AS pos FROM n) SELECT user_id, CAST(pos AS INT) AS pos, round(coalesce(value, 0), 6) AS v FROM g LEFT JOIN s USING (user_id, pos)")
def pad_truncate(spark: SparkSession, d: str) -> DataFrame:
    """The first 60 values, which are all that the operator keeps, are picked before they are collected."""
    s = samples(spark, d).where("pos < 60").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("a"))
    x = s.select("user_id", F.posexplode(arrays.pad(F.transform("a", lambda v: v["value"]), 60)).alias("pos", "v"))
    return x.select("user_id", "pos", r6(F.col("v")).alias("v"))


@query(f"WITH {_EMB} SELECT label, CAST(pos AS INT) AS pos, round(avg(v), 6) AS mean FROM e GROUP BY 1, 2")
def tensor_group_mean(spark: SparkSession, d: str) -> DataFrame:
    """A8."""
    m = arrays.array_mean(t(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("x")), ["label"], "x")
    return m.select("label", F.posexplode("mean").alias("pos", "mean")).withColumn("mean", r6(F.col("mean")))


_MONTAGE = ('fz', 'FC1', 'Cz', 'af4', 'O1', 'F1', 'cpz', 'PO3', 'C3', 'P2', 'FCZ', 'c4', 'AFz')
_PRIO = ", ".join(f"('{t}', '{w}', {r})" for t, near in NEIGHBOURS.items() for r, w in enumerate((t, *near)))


@query(f"""WITH c AS (SELECT s_suppkey AS subject, i AS ch_pos, [{', '.join(f"'{x}'" for x in _MONTAGE)}][(s_suppkey * m + i * 3) % 13 + 1] AS channel FROM supplier, (VALUES (0, 1), (1, 1), (2, 2), (3, 2), (4, 3)) v(i, m)),
pr AS (SELECT * FROM (VALUES {_PRIO}) p(target, wanted, rk)), cand AS (SELECT subject, target, rk, channel <> wanted AS other, ch_pos, channel, row_number() OVER (PARTITION BY subject, target ORDER BY rk, channel <> wanted, ch_pos) AS k FROM c JOIN pr ON lower(channel) = lower(wanted)),
t AS (SELECT DISTINCT subject, target FROM c, pr)
SELECT t.subject, t.target, coalesce(channel, 'ZERO_PLACEHOLDER') AS mapped_to, CASE WHEN channel IS NULL THEN 'placeholder' WHEN rk > 0 AND other THEN 'neighbor_case(' || channel || ')' WHEN rk > 0 THEN 'neighbor(' || channel || ')' WHEN other THEN 'case_insensitive' ELSE 'exact' END AS method, CAST(coalesce(ch_pos, -1) AS INT) AS ch_pos FROM t LEFT JOIN cand ON t.subject = cand.subject AND t.target = cand.target AND k = 1""")
def channel_priority(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's five channels, by its key."""
    n, k = F.array(*map(F.lit, _MONTAGE)), F.col("s_suppkey")
    c = t(spark, d, "supplier").select(k.alias("subject"), F.posexplode(F.array(*[F.get(n, ((k * m + i * 3) % 13).cast("int")) for i, m in enumerate((1, 1, 2, 2, 3))])).alias("ch_pos", "channel"))
    return channels.channel_map(c, channels.priorities(spark), ["subject"]).select("subject", "target", "mapped_to", "method", "ch_pos")


@query(f"WITH {_EPOCHS} SELECT name AS condition, count(*) AS n, count(DISTINCT subject) AS subjects FROM ep WHERE NOT is_rest GROUP BY 1")
def condition_totals(spark: SparkSession, d: str) -> DataFrame:
    """A4, Q20: task epochs by condition over all subjects."""
    return epoch_table(spark, d).where("kind = 'task'").groupBy("condition").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("subjects"))


@query("WITH c AS (SELECT user_id, event_type AS k, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, string_agg(k || '=' || n, ',' ORDER BY k) AS conditions FROM c GROUP BY 1")
def map_counts(spark: SparkSession, d: str) -> DataFrame:
    """A3: the map as text."""
    m = qc.condition_maps(t(spark, d, "events").select("user_id", F.col("event_type").alias("condition")), ["user_id"])
    return m.select("user_id", F.array_join(F.transform(F.map_entries("conditions"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("conditions"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 5")
def topk_subjects(spark: SparkSession, d: str) -> DataFrame:
    """O1, O2."""
    return t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(5)


def files(spark: SparkSession, d: str) -> DataFrame:
    """subject, path, length of files as a scan lists them, one a page: its id gives the folder and the kind, its html the length. Folders hold five files of one to five kinds."""
    k = F.col("page_id")
    kinds = F.array(*map(F.lit, _KINDS))
    name = F.concat(F.lit("/data/"), "subject", F.lit("/eeg/x"), k.cast("string"), F.get(kinds, ((k % 5 * (F.floor(k / 5) % 4) + F.floor(k / 5)) % len(_KINDS)).cast("int")))
    p = t(spark, d, "pages").withColumn("__s", F.floor(k / 5)).withColumn("subject", subject("__s"))
    return p.select("subject", name.alias("path"), (F.octet_length(F.coalesce("html", F.lit(""))) * (k % 4) * 300).cast("long").alias("length"))


_KINDS = ("_task-rest_events.tsv", "_task-verbalwm_events.tsv", ".vhdr", ".eeg", ".vmrk", "_beh.tsv", "_events.tsv")
_FILES = f"""fl AS (SELECT {_SUBJECT.format("page_id // 5")} AS subject, '/data/' || {_SUBJECT.format("page_id // 5")} || '/eeg/x' || page_id || [{", ".join(f"'{x}'" for x in _KINDS)}][(page_id % 5 * (page_id // 5 % 4) + page_id // 5) % {len(_KINDS)} + 1] AS path, CAST(octet_length(encode(coalesce(html, ''))) * (page_id % 4) * 300 AS BIGINT) AS length FROM pages)"""


@query(f"""WITH {_FILES}, e AS (SELECT *, lower(split_part(path, '/', 5)) AS name FROM fl WHERE path LIKE '%\\_events.tsv' ESCAPE '\\'),
f AS (SELECT subject, list_sort(list(path)) AS ps, max(path) FILTER (WHERE contains(name, 'verbalwm')) AS t, max(path) FILTER (WHERE contains(name, 'rest') AND NOT contains(name, 'verbalwm')) AS r FROM e GROUP BY 1),
g AS (SELECT subject, ps, CASE WHEN t IS NULL AND len(ps) = 1 THEN ps[1] ELSE t END AS t, CASE WHEN r IS NULL AND len(ps) = 1 THEN ps[1] ELSE r END AS r FROM f),
h AS (SELECT subject, ps, CASE WHEN t IS NULL AND r IS NOT NULL THEN list_filter(ps, lambda p: p <> r)[1] ELSE t END AS t, r FROM g)
SELECT subject, coalesce(t, ps[1]) AS task_file, CASE WHEN r IS NULL AND t IS NOT NULL THEN list_filter(ps, lambda p: p <> t)[1] ELSE r END AS rest_file FROM h""")
def event_file_resolution(spark: SparkSession, d: str) -> DataFrame:
    """J3, G18; the registry names a subject's first events file."""
    f = files(spark, d)
    first = f.where(F.endswith("path", F.lit("_events.tsv"))).groupBy("subject").agg(F.min("path").alias("events_path"))
    return epochs.event_files(f, first)


@query(f"WITH {_S} SELECT 'sub-' || user_id AS subject, CAST(pos // 32 AS BIGINT) AS chunk_idx, count(*) AS n, sum(floor(coalesce(value, 0) * 1000 + 0.5)) / 1000 AS total, CAST(max(n_all) AS BIGINT) AS n_samples FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n_all FROM s) GROUP BY 1, 2")
def recordings_written_and_read(spark: SparkSession, d: str) -> DataFrame:
    """Every user's values written as a recording, and read back by ranges."""
    root = brainvision.scratch_root(spark)
    s = samples(spark, d).withColumn("chunk_idx", F.floor(F.col("pos") / 256))
    rows = s.groupBy("user_id", "chunk_idx").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("value", F.lit(0.0)).alias("v")))).alias("a"))
    rows = rows.select(F.concat(F.lit("sub-"), F.col("user_id").cast("string")).alias("subject"), F.lit("x").alias("channel"), F.lit(0).alias("ch_pos"), "chunk_idx", F.transform("a", lambda v: v["v"]).alias("samples"))
    brainvision.write_recordings(rows, root, 1000.0).write.format("noop").mode("overwrite").save()
    back = brainvision.recording_chunks(spark, root, 32, 1 << 10)
    return back.select("subject", "chunk_idx", F.size("samples").cast("long").alias("n"), F.aggregate("samples", F.lit(0.0), lambda a, v: a + v).alias("total"), "n_samples")


@query(f"WITH {_FILES} SELECT path, length FROM fl WHERE length > 0 AND (length // 300) % 3 <> 0")
def file_resume_diff(spark: SparkSession, d: str) -> DataFrame:
    """Files are here at their full length, cut short or not at all, by their length."""
    f = files(spark, d).select("path", "length")
    third = F.floor(F.col("length") / 300) % 3
    here = f.where(third == 0).unionAll(f.where(third == 1).withColumn("length", F.col("length") - 1))
    return qc.to_fetch(f, here)


@query(f"WITH {_FILES}, x AS (SELECT length = 0 OR (length // 300) % 3 = 0 AS skip, contains(path, '.eeg') AS bad FROM fl) SELECT count(*) FILTER (WHERE NOT skip AND NOT bad) AS downloaded, count(*) FILTER (WHERE skip) AS skipped, count(*) FILTER (WHERE NOT skip AND bad) AS failed, count(*) FILTER (WHERE NOT skip AND bad) = 0 AS success FROM x")
def fetch_counts(spark: SparkSession, d: str) -> DataFrame:
    """Signals fail."""
    f = files(spark, d).select("path", "length")
    return qc.fetch_counts(f, f.where(F.floor(F.col("length") / 300) % 3 == 0), f.where(F.contains("path", F.lit(".eeg"))))


_VALID = """v AS (SELECT subject, concat_ws(',', CASE WHEN count(*) FILTER (WHERE suffix(path, '.vhdr')) = 0 THEN '.vhdr' END, CASE WHEN count(*) FILTER (WHERE suffix(path, '.eeg')) = 0 THEN '.eeg' END, CASE WHEN count(*) FILTER (WHERE suffix(path, '.vmrk')) = 0 THEN '.vmrk' END) AS missing, CAST(count(*) FILTER (WHERE suffix(path, '.eeg') AND length < 1048576) AS INT) AS n_small, arg_min(length, path) FILTER (WHERE suffix(path, '.eeg')) AS first_length FROM fl GROUP BY 1),
w AS (SELECT subject, missing, n_small, CASE WHEN missing <> '' THEN 'missing' WHEN first_length < 1048576 THEN 'small' ELSE 'valid' END AS verdict FROM v)"""


@query(f"WITH {_FILES}, {_VALID} SELECT * FROM w")
def file_validity(spark: SparkSession, d: str) -> DataFrame:
    """F14, G21."""
    v = qc.validate_files(files(spark, d))
    return v.select("subject", F.array_join("missing", ",").alias("missing"), F.col("n_small").cast("int").alias("n_small"), "verdict")


@query(f"WITH {_FILES}, {_VALID} SELECT verdict, count(*) AS n, min(subject) AS first, max(subject) AS last FROM w GROUP BY 1")
def validation_summary(spark: SparkSession, d: str) -> DataFrame:
    """A25."""
    return qc.validation_summary(qc.validate_files(files(spark, d)))


@query(f"WITH {_REG}, {_FILES}, {_VALID}, g AS (SELECT subject FROM reg WHERE status <> 'skip' AND subject IN (SELECT subject FROM w WHERE verdict = 'valid') ORDER BY 1 LIMIT 1) SELECT subject, sfreq, string_agg(channel, ',' ORDER BY i) AS channels FROM g JOIN reg USING (subject) JOIN ch USING (subject) GROUP BY 1, 2")
def header_sanity_check(spark: SparkSession, d: str) -> DataFrame:
    """G22, O2."""
    return metadata.sanity_check(registry_of(spark, d), qc.validate_files(files(spark, d))).withColumn("channels", F.array_join("channels", ","))


@query("WITH a AS (SELECT user_id, event_id FROM events WHERE event_type = 'purchase' AND value > 50), b AS (SELECT user_id, event_id FROM events WHERE event_type = 'view') SELECT * FROM a UNION ALL SELECT * FROM b WHERE user_id NOT IN (SELECT user_id FROM a)")
def rest_fallback(spark: SparkSession, d: str) -> DataFrame:
    """J9."""
    e = t(spark, d, "events")
    return epochs.with_fallback(e.where("event_type = 'purchase' AND value > 50").select("user_id", "event_id"), e.where("event_type = 'view'").select("user_id", "event_id"), ["user_id"])


@query(f"WITH {_S} SELECT user_id, min_by(label, pos) FILTER (WHERE value > 50) AS label FROM s WHERE value > 50 GROUP BY 1")
def first_non_empty(spark: SparkSession, d: str) -> DataFrame:
    """W8."""
    return registry.first_success(samples(spark, d).where("value > 50"), ["user_id"], "label", "pos")


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS epoch_idx, lpad(CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS VARCHAR), 4, '0') AS epoch_key FROM events")
def epoch_numbers(spark: SparkSession, d: str) -> DataFrame:
    """W7."""
    return registry.numbered(t(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id")


def _recursion_sql(name: str, source: str, b: list[float], a: list[float]) -> str:
    """A filter by its difference equation, a sample a step, from the state of a steady input; source: user_id, i, v."""
    level, dim = sum(b) / sum(a), len(a) - 1
    steady = [sum(b[i] - level * a[i] for i in range(k + 1, dim + 1)) for k in range(dim)]
    y = f"({b[0]:.17e} * e.v + f.z1)"
    step = ", ".join(f"{f'f.z{k + 1} + ' if k < dim else ''}{b[k]:.17e} * e.v - {a[k]:.17e} * {y}" for k in range(1, dim + 1))
    return f"{name} AS (SELECT user_id, -1 AS i, 0e0 AS y, {', '.join(f'{x:.17e} * v AS z{k + 1}' for k, x in enumerate(steady))} FROM {source} WHERE i = 0 UNION ALL SELECT e.user_id, e.i, {y}, {step} FROM {name} f JOIN {source} e ON e.user_id = f.user_id AND e.i = f.i + 1)"


_BAND = tuple(c.tolist() for c in kernels.butter(3, 0.5, 8.0, 20.0))


@query(f"""WITH RECURSIVE {_S}, n AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1 HAVING count(*) > 21), x AS (SELECT user_id, n, CAST(pos AS INT) AS pos, coalesce(value, 0) AS v FROM s JOIN n USING (user_id)),
e1 AS MATERIALIZED (SELECT user_id, pos + 21 AS i, v FROM x UNION ALL SELECT x.user_id, 21 - x.pos, 2 * f.v - x.v FROM x JOIN x f ON f.user_id = x.user_id AND f.pos = 0 WHERE x.pos BETWEEN 1 AND 21
  UNION ALL SELECT x.user_id, CAST(21 + 2 * (x.n - 1) - x.pos AS INT), 2 * f.v - x.v FROM x JOIN x f ON f.user_id = x.user_id AND f.pos = x.n - 1 WHERE x.pos BETWEEN x.n - 22 AND x.n - 2),
{_recursion_sql("f1", "e1", *_BAND)}, e2 AS MATERIALIZED (SELECT user_id, CAST(n + 41 - i AS INT) AS i, y AS v FROM f1 JOIN n USING (user_id) WHERE i >= 0), {_recursion_sql("f2", "e2", *_BAND)}
SELECT user_id, CAST(n + 20 - i AS BIGINT) AS pos, round(y, 6) + 0.0 AS filtered FROM f2 JOIN n USING (user_id) WHERE i BETWEEN 21 AND n + 20""")
def bandpass_filter(spark: SparkSession, d: str) -> DataFrame:
    """Each recording at 20 Hz, 0.5-8 Hz, in chunks; those of 21 samples or fewer, which cannot be filtered, go."""
    c = preprocess.chunks_of(samples(spark, d).select("user_id", F.lit("x").alias("channel"), "pos", F.coalesce("value", F.lit(0.0)).alias("value")), CHUNK, ("user_id",))
    x = filters.zero_phase(c, ["user_id"], CHUNK, *map(np.array, _BAND)).select("user_id", "chunk_idx", F.posexplode("samples").alias("i", "v"))
    return x.select("user_id", (F.col("chunk_idx") * CHUNK + F.col("i")).alias("pos"), (F.round("v", 6) + F.lit(0.0)).alias("filtered"))


@query()
def ppg_feature_table(spark: SparkSession, d: str) -> DataFrame:
    """Each epoch of a recording at 20 Hz."""
    return hest.ppg_features(epoch_arrays(spark, d).withColumnRenamed("samples", "ppg"), ["user_id", "epoch_idx"], 20.0)


@query()
def beat_tensors(spark: SparkSession, d: str) -> DataFrame:
    """G7, G12, G13, G14 on all epochs of all recordings: pulses every 0.8 s and the user's values as noise, at 250 Hz; last epochs are padded."""
    p, fs, one = Params(fs=250.0), 250.0, ["subject", "kind", "epoch_idx"]
    e = epoch_arrays(spark, d).withColumn("x", arrays.pad(F.col("samples"), EPOCH))
    e = e.select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("subject"), F.when(F.col("epoch_idx") % 2 == 1, "rest").when(F.col("user_id") % 4 == 0, "rest").otherwise("task").alias("kind"),
        "epoch_idx", F.lit("fast").alias("condition"), F.lit(2).alias("label_int"), F.lit(fs).alias("fs"), "x")
    ecg = F.transform("x", lambda v, k: F.exp(-F.pow((k % 200 - 100) / 4.0, 2)) + v / 1000.0)
    eeg = e.select(*one, F.lit("Cz").alias("channel"), F.transform("x", lambda v, k: F.sin(k / 10.0) + v / 1000.0).cast("array<float>").alias("samples"))
    cmap = channels.channel_map(e.select("subject", F.lit("Cz").alias("channel"), F.lit(0).alias("ch_pos")).distinct(), channels.priorities(spark), ["subject"])
    return hest.normalized(hest.representations(e.withColumn("ecg", ecg.cast("array<float>")).drop("x"), eeg, cmap, p), p)


@query("""WITH q AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'view') AS r FROM events GROUP BY 1), ok AS (SELECT * FROM q WHERE n >= 64)
SELECT 'status' AS panel, CASE WHEN n >= 64 THEN 'success' ELSE 'skip' END AS item, count(*) AS value FROM q GROUP BY 2
UNION ALL SELECT 'conditions', event_type, count(*) FROM events JOIN ok USING (user_id) GROUP BY 2
UNION ALL SELECT 'beats', CAST(user_id AS VARCHAR), n FROM ok
UNION ALL SELECT 'rest', 'with_rest', count(*) FILTER (WHERE r > 10) FROM ok UNION ALL SELECT 'rest', 'without_rest', count(*) FILTER (WHERE r <= 10) FROM ok""")
def representation_panels(spark: SparkSession, d: str) -> DataFrame:
    """K9, 2.6, A4, A21: users as subjects, their events as beats."""
    e = t(spark, d, "events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("condition"))
    n = e.groupBy("subject").agg(F.count("*").alias("n_beats_total"), F.greatest(F.count_if(F.col("condition") == "view") - 10, F.lit(0)).alias("n_rest"))
    n = n.withColumn("status", F.when(F.col("n_beats_total") >= 64, "success").otherwise("skip"))
    return hest.panels(n.join(qc.condition_maps(e, ["subject"]), "subject"))


@query(f"WITH {_EMB}, f AS (SELECT min(vec_id) AS vec_id FROM embeddings WHERE label = 1) SELECT CAST(pos // 16 AS INT) AS band, CAST(pos % 16 AS INT) AS time, round(v + 2 * (pos // 16), 6) AS value FROM e JOIN f USING (vec_id)")
def band_traces(spark: SparkSession, d: str) -> DataFrame:
    """The first vector of a label as one channel of four bands."""
    e = t(spark, d, "embeddings").where("label = 1").select(F.lit("s").alias("subject"), F.col("vec_id").alias("epoch_idx"), F.col("embedding").alias("hest_norm"))
    first = recordings.first_epoch(e, spark.createDataFrame([("s", "success")], "subject string, status string"))
    return hest.band_traces(first, 16).withColumn("value", r6(F.col("value")))


@query(f"WITH {_EMB}, k AS (SELECT vec_id FROM embeddings WHERE label = 0 AND vec_id % 5 >= 3) SELECT CAST(pos AS INT) AS pos, round(avg(v), 6) AS mean, round(stddev_pop(v) + 1e-8, 6) AS std FROM e JOIN k USING (vec_id) GROUP BY 1")
def rest_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Label 0 is rest, the id gives the beats."""
    e = t(spark, d, "embeddings").select(F.lit("s").alias("subject"), F.when(F.col("label") == 0, "rest").otherwise("task").alias("kind"), (F.col("vec_id") % 5).alias("n_beats"), F.col("embedding").cast("array<double>").alias("hest"), F.lit(None).cast("string").alias("error"))
    s = hest.rest_stats(e, Params()).select(F.posexplode(F.arrays_zip("mean", "std")).alias("pos", "z"))
    return s.select("pos", r6(F.col("z.mean")).alias("mean"), r6(F.col("z.std")).alias("std"))
