"""Recordings by ranges, and event files by the order of fallbacks."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatloom.operators import epochs, qc
from beatloom.sources import brainvision as bv
from tests.conftest import SF
from tests.oracle import compare


def header(name, channels, orientation, fmt):
    lines = ["[Common Infos]", f"DataFile={name}.eeg", f"DataOrientation={orientation}", "SamplingInterval=2000", "[Binary Infos]", f"BinaryFormat={fmt}", "[Channel Infos]"]
    return "\n".join([*lines, *[f"Ch{i + 1}={c},,{0.5 if i else ''},u" for i, c in enumerate(channels)]])


@pytest.mark.parametrize("range_bytes", [1, 200, 1 << 20])
def test_ranges_give_all_samples(spark, tmp_path, range_bytes):
    rng, want = np.random.default_rng(3), {}
    for sub, orientation, fmt, n in (("sub-01", "MULTIPLEXED", "INT_16", 100), ("sub-02", "VECTORIZED", "INT_32", 37), ("sub-03", "MULTIPLEXED", "IEEE_FLOAT_32", 0)):
        folder = tmp_path / sub / "eeg"
        folder.mkdir(parents=True)
        x = rng.integers(-999, 999, size=(3, n)).astype(bv.KINDS[fmt])
        (folder / "a.vhdr").write_text(header("a", ["Fz", "ECG", "x\\1y"], orientation, fmt))
        (folder / "a.eeg").write_bytes((x if orientation == "VECTORIZED" else x.T).tobytes() + b"\0")
        want |= {(sub, c): x[c] * (0.5 if c else 1.0) for c in range(3) if n}
    (tmp_path / "sub-03" / "eeg" / "bad.vhdr").write_text("[Common Infos]\nDataFile=a.eeg")
    (tmp_path / "sub-03" / "eeg" / "lost.vhdr").write_text(header("lost", ["a"], "MULTIPLEXED", "INT_16"))
    got = bv.recording_chunks(spark, str(tmp_path), 8, range_bytes)
    assert got.rdd.getNumPartitions() > (20 if range_bytes == 1 else 0)
    parts = {}
    for r in got.orderBy("chunk_idx").collect():
        assert len(r.samples) <= 8 and r.fs == 500.0
        parts.setdefault((r.subject, r.ch_pos), []).extend(r.samples)
    assert {k: np.allclose(v, want[k]) for k, v in parts.items()} == dict.fromkeys(want, True)
    heads = bv.recording_chunks(spark, str(tmp_path), samples=False).collect()
    assert {(r.subject, r.channel): r.n_samples for r in heads}["sub-01", "x,y"] == 100 and len(heads) == 9


def test_file_beyond_two_gigabytes(tmp_path):
    """A sparse file: many ranges, none larger than asked for, and the last one is reached by a seek."""
    folder = tmp_path / "sub-09" / "eeg"
    folder.mkdir(parents=True)
    n = 700_000_000
    (folder / "a.vhdr").write_text(header("a", ["a", "b"], "MULTIPLEXED", "INT_16"))
    with open(folder / "a.eeg", "wb") as f:
        f.truncate(4 * n)
        f.seek(4 * (n - 2))
        f.write(np.array([[1, 2], [3, 4]], dtype="<i2").tobytes())
    assert os.path.getsize(folder / "a.eeg") > 1 << 31
    reader = bv.Reader({"root": str(tmp_path), "rangeBytes": str(16 << 20)})
    parts = reader.partitions()
    assert len(parts) == -(-4 * n // (16 << 20)) and all((p.stop - p.first) * bv.CHUNK * 4 <= 16 << 20 for p in parts)
    assert [p.first for p in parts[1:]] == [p.stop for p in parts[:-1]] and parts[-1].stop == -(-n // bv.CHUNK)
    last = list(reader.read(parts[-1]))[-1].to_pylist()
    assert [r["samples"][-2:] for r in last] == [[1.0, 3.0], [1.0, 2.0]]


def test_written_recordings_come_back(spark, tmp_path):
    rows = [(f"sub-{s}", c, p, k, [s + p + k / 8 + i for i in range(4 if k < 2 else 3)]) for s in range(3) for p, c in enumerate(["Fz", "a,b"]) for k in range(3)]
    df = spark.createDataFrame(rows, "subject string, channel string, ch_pos int, chunk_idx long, samples array<double>")
    written = {r.subject: r.n_samples for r in bv.write_recordings(df, str(tmp_path), 250.0).collect()}
    assert written == {f"sub-{s}": 11 for s in range(3)}
    back = bv.recording_chunks(spark, str(tmp_path), 4)
    assert sorted((r.subject, r.channel, r.ch_pos, r.chunk_idx, [round(v, 6) for v in r.samples]) for r in back.collect()) == sorted((a, b, c, d, [float(v) for v in e]) for a, b, c, d, e in rows)
    assert {r.fs for r in back.select("fs").distinct().collect()} == {250.0} and not list(tmp_path.rglob("*.eeg.*"))
    assert bv.write_recordings(df.limit(0), str(tmp_path / "none"), 250.0).count() == 0


@pytest.mark.parametrize("name", ["event_file_resolution", "recordings_written_and_read"])
def test_against_sql(spark, name):
    compare(spark, name, SF)


CASES = {
    "both": (["a_task-rest_events.tsv", "b_task-verbalwm_events.tsv"], 1, 0), "one": (["a_events.tsv"], 0, 0), "one_rest": (["a_rest_events.tsv"], 0, 0),
    "rest_and_other": (["a_events.tsv", "b_rest_events.tsv", "c_events.tsv"], 0, 1), "task_and_other": (["a_VerbalWM_events.tsv", "b_events.tsv"], 0, 1),
    "unnamed": (["a_events.tsv", "b_events.tsv"], None, None), "two_tasks": (["a_verbalwm_events.tsv", "b_verbalwm_events.tsv"], 1, 0), "two_rests": (["a_rest_events.tsv", "b_rest_events.tsv"], 0, 1),
}


def test_event_file_fallbacks(spark):
    rows = [(s, f"/data/sub-{s}/eeg/{f}") for s, (names, *_) in CASES.items() for f in [*names, "x.vhdr"]]
    df = spark.createDataFrame(rows, "subject string, path string")
    path = lambda s, k: None if k is None else f"/data/sub-{s}/eeg/{CASES[s][0][k]}"
    want = {s: (path(s, t), path(s, r)) for s, (_, t, r) in CASES.items()}
    assert {r.subject: (r.task_file, r.rest_file) for r in epochs.event_files(df).collect()} == want
    registry = spark.createDataFrame([("unnamed", "/reg/first_events.tsv"), ("both", "/reg/x")], "subject string, events_path string").withColumn("path", F.lit(1))
    got = {r.subject: (r.task_file, r.rest_file) for r in epochs.event_files(df, registry).collect()}
    assert got == want | {"unnamed": ("/reg/first_events.tsv", None)}


def test_validity_goes_by_the_first_signal(spark):
    files = [("a", "1.eeg", 2 << 20), ("a", "2.eeg", 5), ("b", "1.eeg", 5), ("b", "2.eeg", 2 << 20), ("c", "1.eeg", 2 << 20)]
    files += [(s, f"x{e}", 9) for s in "ab" for e in (".vhdr", ".vmrk")]
    got = qc.validate_files(spark.createDataFrame(files, "subject string, path string, length long")).collect()
    assert {r.subject: (r.verdict, r.n_small) for r in got} == {"a": ("valid", 1), "b": ("small", 1), "c": ("missing", 0)}


def test_many_small_recordings_share_partitions(spark, tmp_path):
    """A large file among many small ones is still cut; the small ones take few partitions, and each sample comes once."""
    want = {}
    for k in range(400):
        folder = tmp_path / f"sub-{k}" / "eeg"
        folder.mkdir(parents=True)
        x = np.arange(400_000 if k == 7 else k % 3 * 5, dtype="<i2")
        (folder / "a.vhdr").write_text(header("a", ["Fz"], "MULTIPLEXED", "INT_16"))
        (folder / "a.eeg").write_bytes(x.tobytes())
        want |= {f"sub-{k}": (int(x.sum()), len(x))} if len(x) else {}
    (tmp_path / "sub-3" / "eeg" / "bad.vhdr").write_text("[Common Infos]")
    parts = bv.Reader({"root": str(tmp_path), "chunk": "32", "rangeBytes": "64"}).partitions()
    assert len(parts) < 200 and sum(isinstance(p, bv.Range) for p in parts) > 8
    assert max(len(p.paths) for p in parts if isinstance(p, bv.Recordings)) < 20
    got = bv.recording_chunks(spark, str(tmp_path), 32, 64).groupBy("subject").agg(F.sum(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v)).cast("long").alias("total"), F.sum(F.size("samples")).alias("n"))
    assert {r.subject: (r.total, r.n) for r in got.collect()} == want
    assert bv.recording_chunks(spark, str(tmp_path), samples=False).count() == 400
