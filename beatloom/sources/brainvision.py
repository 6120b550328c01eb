"""Recordings as a Spark data source that reads ranges, and a writer of recordings.

A scan is planned from a listing. A data file of more than about `rangeBytes` is cut into ranges, a partition each: its header is read then, and
a task seeks to its range and gives a row a channel and chunk, so neither a task nor a cell grows with a recording. Smaller recordings
share partitions where they are many, and tasks read their headers, so neither the planning nor the number of tasks grows with a small file's header.
Ranges are made larger, up to PACK_BYTES, where there would be more than PARTITIONS of them. With the option samples=false only headers are read.

Files are reached through pyarrow's file systems (local and mounted folders, HDFS, object stores). A data file lies in its header's folder. Cases: a
header that cannot be read, or whose data file is missing, has no rows (`recordings.headers` names the error); bytes behind the last whole sample are
left out; an empty data file has no chunks; a root without headers gives no rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .recordings import parse_header

KINDS = {"INT_16": "<i2", "INT_32": "<i4", "IEEE_FLOAT_32": "<f4"}
HEAD = "subject string, header_path string, channel string, ch_pos int, fs double, n_samples long"
CHUNK, RANGE_BYTES = 4096, 64 << 20
#: Partitions below which nothing is put together; bytes that opening a recording counts for; the most that is put together for a task, and in a batch.
PARTITIONS, OPEN_BYTES, PACK_BYTES, BATCH_BYTES = 128, 16 << 10, 16 << 20, 64 << 10


@dataclass
class Range(InputPartition):
    """Chunks [first, stop) of one recording: of all its channels, or, where they lie one after another, of one."""

    subject: str
    header_path: str
    data_path: str
    channels: list[str]
    resolutions: list[float]
    fs: float
    kind: str
    n_samples: int
    channel: int | None
    first: int
    stop: int


@dataclass
class Recordings(InputPartition):
    """Whole recordings, none larger than a range, by the paths of their headers."""

    paths: list[str]


def _subject(path: str) -> str | None:
    return next((part for part in path.split("/")[:-1] if part.startswith("sub-")), None)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.chunk = options["root"], int(options.get("chunk", CHUNK))
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        self.samples = str(options.get("samples", "true")).lower() != "false"

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.root)
        found = sorted(self._listed(store, root))
        share = min(sum(n + OPEN_BYTES for _, n in found) // PARTITIONS, PACK_BYTES)
        size = self.range_bytes
        if sum(-(-n // max(size, 2 * self.chunk)) for _, n in found) > PARTITIONS:
            size = max(size, share)
        out, held, cost = [], [], 0
        for path, n in found:
            if n > size and self.samples:
                out += self._ranges(store, path, size)
                continue
            if held and cost + n + OPEN_BYTES > share:
                out.append(Recordings(held))
                held, cost = [], 0
            held.append(path)
            cost += (n if self.samples else 0) + OPEN_BYTES
        return [*out, Recordings(held)] if held else out

    def _listed(self, store: fs.FileSystem, root: str) -> Iterator[tuple[str, int]]:
        """The path of each header, and the bytes of the largest other file in its folder, which is no smaller than its data."""

        def below(folder: str) -> list[tuple[str, int]]:
            return headed(store.get_file_info(fs.FileSelector(folder, recursive=True)))

        def headed(files: list[fs.FileInfo]) -> list[tuple[str, int]]:
            files = [(f.path, f.size) for f in files if f.type == fs.FileType.File]
            heads, largest = [path for path, _ in files if path.endswith(".vhdr")], {}
            for path, n in files:
                folder = path.rpartition("/")[0]
                largest[folder] = max(largest.get(folder, 0), 0 if path.endswith(".vhdr") else n)
            return [(path, largest[path.rpartition("/")[0]]) for path in heads]

        top = store.get_file_info(fs.FileSelector(root))
        yield from headed(top)
        with ThreadPoolExecutor(8) as pool:
            for part in pool.map(below, [f.path for f in top if f.type == fs.FileType.Directory]):
                yield from part

    def _ranges(self, store: fs.FileSystem, path: str, size: int) -> Iterator[Range]:
        try:
            with store.open_input_stream(path) as f:
                h = parse_header(f.read().decode("utf-8", "replace"))
            rate, data, kind = 1e6 / float(h["samplinginterval"]), path.rsplit("/", 1)[0] + "/" + h["datafile"], KINDS[h.get("binary_format", "INT_16")]
        except (KeyError, ValueError, ZeroDivisionError):
            return
        width, file = np.dtype(kind).itemsize, store.get_file_info(data)
        if file.type != fs.FileType.File or not h["channels"]:
            return
        n = file.size // (width * len(h["channels"]))
        own = (_subject(path), path, data, h["channels"], h["resolutions"], rate, kind, n)
        if not self.samples:
            yield Range(*own, None, 0, 0)
            return
        apart = h.get("dataorientation", "MULTIPLEXED").upper() == "VECTORIZED"
        step = max(1, size // (self.chunk * width * (1 if apart else len(h["channels"]))))
        for channel in range(len(h["channels"])) if apart else [None]:
            for first in range(0, -(-n // self.chunk), step):
                yield Range(*own, channel, first, min(first + step, -(-n // self.chunk)))

    def read(self, partition: Range | Recordings) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.root)
        ranges = [partition] if isinstance(partition, Range) else (r for path in partition.paths for r in self._ranges(store, path, self.range_bytes))
        held, cost = [], 0
        for part in (c for r in ranges for c in self._chunks(store, r)):
            held.append(part)
            cost += 64 * len(part[1]) + (0 if part[3] is None else part[3].nbytes)
            if cost >= BATCH_BYTES:
                yield self._batch(held)
                held, cost = [], 0
        if held:
            yield self._batch(held)

    def _chunks(self, store: fs.FileSystem, p: Range) -> Iterator[tuple[Range, list[int], int, np.ndarray | None]]:
        """The range, its channels, and the number and samples (channels by samples) of each chunk."""
        names = list(range(len(p.channels))) if p.channel is None else [p.channel]
        if not self.samples:
            yield p, names, 0, None
            return
        if p.first == p.stop:
            return
        width, units = np.dtype(p.kind).itemsize, np.array([p.resolutions[c] for c in names])[:, None]
        with store.open_input_file(p.data_path) as f:
            for k in range(p.first, p.stop):
                start, n = k * self.chunk, min(self.chunk, p.n_samples - k * self.chunk)
                f.seek(width * (start * len(p.channels) if p.channel is None else p.channel * p.n_samples + start))
                yield p, names, k, np.frombuffer(f.read(width * n * len(names)), dtype=p.kind).reshape(n, len(names)).T * units

    def _batch(self, parts: list[tuple[Range, list[int], int, np.ndarray | None]]) -> pa.RecordBatch:
        rows = [(p, c) for p, names, _, _ in parts for c in names]
        columns = {
            "subject": pa.array([p.subject for p, _ in rows], pa.string()), "header_path": pa.array([p.header_path for p, _ in rows], pa.string()), "channel": pa.array([p.channels[c] for p, c in rows], pa.string()),
            "ch_pos": pa.array([c for _, c in rows], pa.int32()), "fs": pa.array([p.fs for p, _ in rows], pa.float64()), "n_samples": pa.array([p.n_samples for p, _ in rows], pa.int64()),
        }
        if self.samples:
            ends = np.cumsum([0, *[x.shape[1] for _, _, _, x in parts for _ in range(len(x))]])
            values = np.concatenate([np.ascontiguousarray(x, dtype=np.float64).reshape(-1) for _, _, _, x in parts])
            columns["chunk_idx"] = pa.array([k for _, names, k, _ in parts for _ in names], pa.int64())
            columns["samples"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
        return pa.RecordBatch.from_pydict(columns)


class BrainVision(DataSource):
    """Options: root; chunk (samples), rangeBytes, samples (true or false)."""

    @classmethod
    def name(cls) -> str:
        return "brainvision"

    def schema(self) -> str:
        return HEAD if str(self.options.get("samples", "true")).lower() == "false" else f"{HEAD}, chunk_idx long, samples array<double>"

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def recording_chunks(spark: SparkSession, root: str, chunk: int = CHUNK, range_bytes: int = RANGE_BYTES, samples: bool = True) -> DataFrame:
    """subject, header_path, channel, ch_pos, fs, n_samples and, a row a chunk, chunk_idx and samples in units."""
    spark.dataSource.register(BrainVision)
    return spark.read.format("brainvision").option("root", root).option("chunk", chunk).option("rangeBytes", range_bytes).option("samples", str(samples).lower()).load()


def write_recordings(chunks: DataFrame, root: str, fs_hz: float, scale: int = 1000) -> DataFrame:
    """Writes subject, channel, ch_pos, chunk_idx, samples as multiplexed 32-bit recordings, values in steps of 1 / scale; gives subject, path, n_samples of what was written.

    One file is one sequence, so one task writes it, a chunk of all channels at a time; every channel of a subject needs the same chunks. A file gets its
    name when it is whole, its header last, so a task that is repeated or lost leaves no half recording.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root)
        own, out, held, names, n, part, target = None, None, [], [], 0, None, None

        def flush() -> None:
            nonlocal n
            x = np.stack(held).T
            out.write(np.floor(x * scale + 0.5).astype("<i4").tobytes())
            n += len(x)
            held.clear()

        def close() -> tuple[str, str, int]:
            flush()
            out.close()
            store.move(f"{target}.eeg.{part}", f"{target}.eeg")
            stem = target.rsplit("/", 1)[1]
            lines = ["Brain Vision Data Exchange Header File", "[Common Infos]", f"DataFile={stem}.eeg", "DataOrientation=MULTIPLEXED", f"NumberOfChannels={len(names)}", f"SamplingInterval={1e6 / fs_hz}"]
            lines += ["[Binary Infos]", "BinaryFormat=INT_32", "[Channel Infos]", *[f"Ch{i + 1}={c.replace(',', chr(92) + '1')},,{1 / scale},u" for i, c in enumerate(names)], ""]
            with store.open_output_stream(f"{target}.vhdr.{part}") as f:
                f.write("\n".join(lines).encode())
            store.move(f"{target}.vhdr.{part}", f"{target}.vhdr")
            return own, f"{target}.vhdr", n

        at = None
        for batch in batches:
            done = []
            for subject, channel, chunk_idx, x in zip(batch["subject"], batch["channel"], batch["chunk_idx"].tolist(), batch["samples"], strict=True):
                if subject != own:
                    if own is not None:
                        done.append(close())
                    own, at, names, n, part = subject, chunk_idx, [], 0, uuid.uuid4().hex
                    target = f"{base}/{subject}/eeg/{subject}_task-verbalwm_eeg"
                    store.create_dir(f"{base}/{subject}/eeg", recursive=True)
                    out = store.open_output_stream(f"{target}.eeg.{part}")
                if chunk_idx != at:
                    flush()
                    at = chunk_idx
                held.append(np.asarray(x, dtype=np.float64))
                if n == 0 and len(names) < len(held):
                    names.append(channel)
            yield pd.DataFrame(done, columns=["subject", "path", "n_samples"])
        if own is not None:
            yield pd.DataFrame([close()], columns=["subject", "path", "n_samples"])

    # a number of tasks of its own: a file takes time however few bytes it has, and by bytes Spark would put most of them into few tasks
    tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = chunks.select("subject", "channel", "ch_pos", "chunk_idx", "samples").repartition(tasks, "subject").sortWithinPartitions("subject", "chunk_idx", "ch_pos")
    return rows.mapInPandas(run, "subject string, path string, n_samples long")


def scratch_root(spark: SparkSession) -> str:
    """A new folder in the one that all executors share; a local session may lack it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
    return f"{shared.rstrip('/')}/recordings-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the folder that all executors share, and read back: plans that read it more than once do so, and lost executors lose none of it."""
    path = scratch_root(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
