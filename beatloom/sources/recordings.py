"""Sources: BrainVision recordings (S4, S5), event tables (S6), folder listings (S8, S9), JSON state (S1-S3), and sinks (K1-K4)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "subject string, header_path string, data_file string, marker_file string, channels array<string>, resolutions array<double>, sfreq double, binary_format string, orientation string, read_error string"
SAMPLE_BYTES = {"INT_16": 2, "INT_32": 4, "IEEE_FLOAT_32": 4}


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Subject, path, length of files below root; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return f.select(F.nullif(F.regexp_extract("path", r"/(sub-[^/]+)/", 1), F.lit("")).alias("subject"), "path", "length")


def event_table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table, all strings, names lower-cased and trimmed."""
    df = spark.read.csv(path, sep="\t", header=True, nullValue="n/a")
    return df.toDF(*[c.lower().strip() for c in df.columns])


def parse_header(text: str) -> dict:
    """Fields of a .vhdr file."""
    section, out = "", {"channels": [], "resolutions": []}
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("["):
            section = line.strip("[]").lower()
        elif "=" in line and not line.startswith(";"):
            k, _, v = line.partition("=")
            if section == "common infos":
                out[k.strip().lower()] = v.strip()
            elif section == "binary infos":
                out["binary_format"] = v.strip()
            elif section == "channel infos":
                parts = v.split(",")
                out["channels"].append(parts[0].replace("\\1", ","))
                out["resolutions"].append(float(parts[2]) if len(parts) > 2 and parts[2].strip() else 1.0)
    return out


def headers(spark: SparkSession, root: str) -> DataFrame:
    """One row a .vhdr file, with n_samples and duration_s from the data file's length and n_annotations from the markers.

    No samples are touched. A file that cannot be parsed gives a row with read_error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content, subject in zip(b["path"], b["content"], b["subject"], strict=True):
                try:
                    h = parse_header(bytes(content).decode("utf-8", "replace"))
                    fs = 1e6 / float(h["samplinginterval"])
                    rows.append((subject, path, h["datafile"], h.get("markerfile"), h["channels"], h["resolutions"], fs, h.get("binary_format", "INT_16"), h.get("dataorientation", "MULTIPLEXED"), None))
                except (KeyError, ValueError) as e:
                    rows.append((subject, path, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HEADER.split(", ")])

    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.vhdr").load(root)
    f = f.select("path", "content", F.regexp_extract("path", r"/(sub-[^/]+)/", 1).alias("subject"))
    h = f.mapInPandas(run, HEADER).withColumn("dir", F.regexp_replace("header_path", "[^/]+$", ""))
    data = listing(spark, root, "*.eeg").select(F.col("path").alias("data_path"), F.col("length").alias("data_bytes"))
    marks = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.vmrk").load(root)
    marks = marks.select(F.col("path").alias("marker_path"), F.regexp_count(F.decode("content", "UTF-8"), F.lit(r"(?m)^Mk[0-9]+=")).cast("long").alias("n_annotations"))
    h = h.join(data, F.concat("dir", "data_file") == F.col("data_path"), "left").join(marks, F.concat("dir", "marker_file") == F.col("marker_path"), "left")
    size = F.create_map(*[F.lit(x) for kv in SAMPLE_BYTES.items() for x in kv])[F.col("binary_format")] * F.size("channels")
    n = F.when(size > 0, F.floor(F.col("data_bytes") / size))
    return h.withColumns({"n_samples": n, "duration_s": n / F.col("sfreq")}).drop("dir", "data_path", "data_bytes", "marker_path")


def signals(spark: SparkSession, root: str) -> DataFrame:
    """A row a channel: subject, channel, ch_pos, fs, n_samples, samples (in units, after the resolution)."""
    h = headers(spark, root).where("read_error IS NULL").withColumn("dir", F.regexp_replace("header_path", "[^/]+$", ""))
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.eeg").load(root).select(F.col("path").alias("data_path"), "content")
    j = h.join(d, F.concat("dir", "data_file") == F.col("data_path"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                kind = {"INT_16": "<i2", "INT_32": "<i4", "IEEE_FLOAT_32": "<f4"}[r.binary_format]
                x = np.frombuffer(bytes(r.content), dtype=kind)
                n = len(r.channels)
                x = x[: len(x) // n * n]
                x = x.reshape(-1, n).T if r.orientation.upper() == "MULTIPLEXED" else x.reshape(n, -1)
                for i, name in enumerate(r.channels):
                    yield pd.DataFrame({"subject": [r.subject], "channel": [name], "ch_pos": [i], "fs": [r.sfreq], "n_samples": [x.shape[1]], "samples": [x[i] * r.resolutions[i]]})

    return j.select("subject", "channels", "resolutions", "sfreq", "binary_format", "orientation", "content").mapInPandas(run, "subject string, channel string, ch_pos int, fs double, n_samples long, samples array<double>")


def signal_chunks(spark: SparkSession, root: str, chunk: int) -> DataFrame:
    """S5 in chunks of a fixed number of samples: subject, channel, chunk_idx, samples, so that no later row grows with a recording."""
    s = signals(spark, root).withColumn("chunk_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_samples") - 1) / chunk))))
    return s.select("subject", "channel", "ch_pos", "fs", "n_samples", "chunk_idx", F.slice("samples", (F.col("chunk_idx") * chunk + 1).cast("int"), F.lit(chunk)).alias("samples"))


def event_tables(spark: SparkSession, files: DataFrame) -> DataFrame:
    """S6 for many files (subject, path): subject, path, row_idx, fields (a map of lower-cased, trimmed names to texts); files differ in columns.

    A file is read whole by one task; event files are small. Of columns of one name the first counts. Unreadable bytes become replacement characters.
    """
    lines = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*_events.tsv")
    paths = [r["folder"] for r in files.select(F.regexp_extract("path", "^(.*)/sub-[^/]+/", 1).alias("folder")).distinct().collect()]  # the roots
    if not paths:
        return spark.createDataFrame([], "subject string, path string, row_idx int, fields map<string,string>")
    text = lines.load(paths).join(files.select("subject", "path"), "path").select("subject", "path", F.split(F.decode("content", "UTF-8"), "\r?\n").alias("lines"))
    names = F.transform(F.split(F.col("lines")[0], "\t"), lambda x: F.lower(F.trim(x)))
    rows = text.select("subject", "path", names.alias("names"), F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("row_idx", "line")).where("line <> ''")
    values = F.transform(F.split("line", "\t"), lambda v: F.when(v != "n/a", v))
    padded = F.slice(F.concat(values, F.array_repeat(F.lit(None).cast("string"), F.size("names"))), F.lit(1), F.size("names"))
    first = F.filter(F.arrays_zip(F.col("names").alias("k"), padded.alias("v")), lambda e, i: F.array_position("names", e["k"]) == i + 1)
    return rows.select("subject", "path", "row_idx", F.map_from_entries(first).alias("fields"))


def label_map(spark: SparkSession, path: str) -> DataFrame:
    """S3: a JSON object of label to condition, as rows."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("label", "condition"))


def keyed_json(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """A JSON object keyed by subject, as rows subject, value."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value_schema}>")).alias("subject", "value"))


def write_stage(df: DataFrame, path: str, codec: str = "gzip") -> None:
    """K2, K4: a stage's table, partitioned by subject."""
    df.write.mode("overwrite").option("compression", codec).partitionBy("subject").parquet(path)


def write_label_map(rows: DataFrame, path: str) -> bool:
    """K3: appends the next version of the map, only if it has a row; tells whether."""
    if rows.isEmpty():
        return False
    rows.withColumn("version", F.lit(latest_version(rows.sparkSession, path) + 1)).coalesce(1).write.mode("append").parquet(path)
    return True


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def latest_version(spark: SparkSession, path: str) -> int:
    return (spark.read.parquet(path).agg(F.max("version")).first()[0] or 0) if _exists(spark, path) else 0


def label_map_or(spark: SparkSession, path: str, discover: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """S3, Q24: the latest stored map; discovered and stored if there is none, or if a refresh is asked for."""
    if refresh or not latest_version(spark, path):
        write_label_map(discover(), path)
    version = latest_version(spark, path)
    if not version:
        return spark.createDataFrame([], "label string, condition string")
    return spark.read.parquet(path).where(F.col("version") == version).select("label", "condition")


def write_qc(qc: DataFrame, path: str) -> None:
    """K7: a quality table as JSON lines; dates and the like as text."""
    qc.write.mode("overwrite").json(path)


def _versions(spark: SparkSession, path: str) -> dict[int, bool]:
    """The versions of a folder's manifest, and whether each was written to its end."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return {}
    return {int(f.getPath().getName()): _exists(spark, f"{path}/manifest/{f.getPath().getName()}/_SUCCESS") for f in fs.listStatus(folder)}


def published(spark: SparkSession, path: str) -> str:
    """The folder of the latest version that was published; raises where there is none."""
    whole = [n for n, done in _versions(spark, path).items() if done]
    if not whole:
        raise FileNotFoundError(f"nothing is published in {path}")
    return f"{path}/{spark.read.text(f'{path}/manifest/{max(whole)}').first()[0]}"


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """K5, K6, K8: a stage's tables, written and checked by write(folder) in a folder of their own, then made the latest version by one row.

    If write raises or is killed, or the row is not finished, readers of published() keep the version before. Earlier versions stay.
    """
    attempt = f"attempt-{uuid.uuid4().hex}"
    write(f"{path}/{attempt}")
    version = max(_versions(spark, path), default=0) + 1
    spark.createDataFrame([(attempt,)], "value string").coalesce(1).write.mode("error").text(f"{path}/manifest/{version}")
    return f"{path}/{attempt}"


def stage_epochs(spark: SparkSession, path: str) -> DataFrame:
    """A stage's epochs in order of subject and number."""
    return spark.read.parquet(path).orderBy("subject", "epoch_idx")


def processed_subjects(qc: DataFrame) -> DataFrame:
    """The subjects that a stage wrote, in order."""
    return qc.where("status = 'success'").select("subject").orderBy("subject")


def first_epoch(stage: DataFrame, qc: DataFrame) -> DataFrame:
    """The first epoch of the first subject that a stage wrote."""
    return stage.join(qc.where("status = 'success'").select("subject"), "subject", "left_semi").orderBy("subject", "epoch_idx").limit(1)


def update_params(spark: SparkSession, path: str, stage: DataFrame, values: dict) -> None:
    """K1, K8: writes the parameters' row only if the stage gave rows, else raises."""
    if stage.isEmpty():
        raise RuntimeError("the stage gave no rows")
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
