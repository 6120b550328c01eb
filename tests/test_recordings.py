"""Sources, sinks and plans on small files written here (E1, E2), kernels against plain definitions, and streaming."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatloom.functions import kernels
from beatloom.operators import epochs, qc, registry
from beatloom.params import PPG_FEATURES, Params
from beatloom.plans import hest, metadata, preprocess
from beatloom.sources import recordings
from beatloom.streaming import ingest

FS, N = 100.0, 1000


def signal(k):
    return np.round(100 * np.sin(np.arange(N) / (5.0 + k))).astype("<i2")


def header(name, channels, orientation="MULTIPLEXED", fmt="INT_16"):
    lines = ["Brain Vision Data Exchange Header File", "; comment = none", "[Common Infos]", f"DataFile={name}.eeg", f"MarkerFile={name}.vmrk", f"DataOrientation={orientation}", f"NumberOfChannels={len(channels)}", f"SamplingInterval={1e6 / FS}"]
    lines += ["[Binary Infos]", f"BinaryFormat={fmt}", "[Channel Infos]", *[f"Ch{i + 1}={c},,{0.5 if i else ''},µV" for i, c in enumerate(channels)]]
    return "\n".join(lines)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """Three good subjects, one without a header, one with a bad one, one without an eeg folder."""
    d = tmp_path_factory.mktemp("data")
    for sub, channels in (("sub-01", ["Fz", "ECG", "Pulse"]), ("sub-02", ["fz", "BIO1"]), ("sub-03", ["Cz", "Pz"])):
        e = d / sub / "eeg"
        e.mkdir(parents=True)
        name = f"{sub}_task-verbalwm"
        (e / f"{name}.vhdr").write_text(header(name, channels, "VECTORIZED" if sub == "sub-02" else "MULTIPLEXED"))
        x = np.stack([signal(k) for k in range(len(channels))])
        (e / f"{name}.eeg").write_bytes((x if sub == "sub-02" else x.T).tobytes())
        (e / f"{name}.vmrk").write_text("[Marker Infos]\nMk1=New Segment,,1,1,0\nMk2=Stimulus,S 1,5,1,0\n")
        rows = ["1.0\tretention_slow", "2.5\tn/a", "4.0\tRest", "9.9\tretention_slow"] if sub != "sub-02" else ["1\tsim", "n/a\tsim"]
        (e / f"{name}_events.tsv").write_text("\n".join([" Onset\tTrial_Type\textra", *[f"{r}\tx" for r in rows], ""]))
    (d / "sub-04" / "eeg").mkdir(parents=True)
    (d / "sub-04" / "eeg" / "note.txt").write_text("no header")
    (d / "sub-05" / "eeg").mkdir(parents=True)
    (d / "sub-05" / "eeg" / "a.vhdr").write_text("[Common Infos]\nDataFile=a.eeg\n")
    (d / "sub-06" / "beh").mkdir(parents=True)
    (d / "sub-06" / "beh" / "sub-06_beh.tsv").write_text("a\tb\n")
    return str(d)


def test_inspect(spark, root):
    reg = {r.subject: r for r in metadata.inspect(spark, root).collect()}
    assert {s: r.status for s, r in reg.items()} == {"sub-01": "ok", "sub-02": "warn", "sub-03": "warn", "sub-04": "skip", "sub-05": "skip", "sub-06": "skip"}
    assert [reg[f"sub-0{k}"].flags for k in range(1, 7)] == [[], ["no_ppg"], ["no_ecg"], ["no_header"], ["no_events_tsv", reg["sub-05"].flags[1]], ["no_eeg_dir"]]
    assert reg["sub-05"].flags[1].startswith("read_error: KeyError")
    one = reg["sub-01"]
    assert (one.channels, one.sfreq, one.duration_s, one.n_annotations) == (["Fz", "ECG", "Pulse"], FS, N / FS, 2)
    assert one.events_path.endswith("_events.tsv") and reg["sub-06"].beh_path.endswith("_beh.tsv")
    p = metadata.panels(metadata.inspect(spark, root))
    got = {(r.panel, r["item"]): r.value for r in p.collect()}
    assert got["status", "skip"] == 3 and got["modality", "eeg_only"] == 1 and got["mean_duration", "all"] == pytest.approx(N / FS / 60) and got["annotations", "sub-02"] == 2
    v = qc.validate_files(recordings.listing(spark, root))
    assert metadata.sanity_check(metadata.inspect(spark, root), v.withColumn("verdict", F.lit("valid"))).first().subject == "sub-01"
    assert metadata.sanity_check(metadata.inspect(spark, root), v).count() == 0  # all signals are small


def test_signals_and_epochs(spark, root):
    got = {(r.subject, r.channel): r for r in recordings.signals(spark, root).collect()}
    for sub, names in (("sub-01", ["Fz", "ECG", "Pulse"]), ("sub-02", ["fz", "BIO1"])):
        for k, c in enumerate(names):
            assert np.allclose(got[sub, c].samples, signal(k) * (0.5 if k else 1.0)) and got[sub, c].n_samples == N
    chunks = recordings.signal_chunks(spark, root, 64)
    assert np.allclose(np.concatenate([r.samples for r in chunks.where("subject = 'sub-01' AND channel = 'ECG'").orderBy("chunk_idx").collect()]), got["sub-01", "ECG"].samples)

    files = recordings.listing(spark, root)
    chosen = epochs.event_files(files).select("subject", F.col("task_file").alias("path"))
    raw = recordings.event_tables(spark, chosen)
    events = raw.select("subject", F.expr("try_cast(fields['onset'] as double)").alias("onset"), F.col("fields")["trial_type"].alias("label"))
    assert events.count() == 10
    reg = metadata.inspect(spark, root)
    rec = recordings.headers(spark, root).select("subject", F.col("sfreq").alias("fs"), "n_samples").where("n_samples IS NOT NULL")
    label_map = preprocess.discovered_labels(events, reg)
    assert {(r.label, r.condition) for r in label_map.collect()} == {("retention_slow", "slow"), ("rest", "rest"), ("sim", "simultaneous")}
    p = Params(fs=FS, tmin=0.0, tmax=2.0)
    rows = preprocess.epoch_rows(events, rec, label_map, p)
    want = {(s, k, 0, c, i, o, o, o + 200) for s in ("sub-01", "sub-03") for k, c, i, o in (("task", "slow", 1, 100), ("rest", "rest", None, 400))}
    assert {tuple(r) for r in rows.collect()} == want  # sub-02 has a missing onset; the last window leaves the recording
    x = preprocess.epoch_signals(rows, chunks, 64)
    for r in x.collect():
        assert np.allclose(r.samples, np.array(got[r.subject, r.channel].samples)[(100 if r.kind == "task" else 400) :][:200].astype(np.float32))
    aux = preprocess.with_aux(rows, x, metadata.aux_channels(reg))
    r = {(r.subject, r.kind): r for r in aux.collect()}
    assert any(r["sub-01", "task"].ecg) and any(r["sub-01", "task"].ppg) and r["sub-03", "task"].ecg == [0.0] * 200
    q = preprocess.preprocessing_qc(reg, rows)
    assert {(s.subject, s.status, s.n_task, s.n_rest) for s in q.collect()} == {("sub-01", "success", 1, 1), ("sub-02", "skip", 0, 0), ("sub-03", "success", 1, 1)}
    t = qc.totals(q).first()
    assert (t.n_ok, t.n_skip, t.n_task, t.with_rest) == (2, 1, 2, 2)


def test_sinks_come_back(spark, root, tmp_path):
    stage = spark.createDataFrame([("s2", 0, "slow", [1.0] * 4), ("s1", 1, "fast", [2.0] * 4), ("s1", 0, "fast", [3.0] * 4)], "subject string, epoch_idx int, condition string, hest_norm array<double>")
    path = f"{tmp_path}/stage"
    recordings.write_stage(stage, path)
    back = recordings.stage_epochs(spark, path)
    assert [(r.subject, r.epoch_idx) for r in back.collect()] == [("s1", 0), ("s1", 1), ("s2", 0)]
    qc.check_written(back, 3, 4)
    for rows, size in ((4, 4), (3, 5)):
        with pytest.raises(RuntimeError):
            qc.check_written(back, rows, size)
    q = spark.createDataFrame([("s1", "success"), ("s2", "skip"), ("s0", "skip")], "subject string, status string")
    recordings.write_qc(q, f"{tmp_path}/qc")
    q = spark.read.json(f"{tmp_path}/qc")
    assert [r.subject for r in recordings.processed_subjects(q).collect()] == ["s1"]
    assert [(r.subject, r.epoch_idx) for r in recordings.first_epoch(back, q).collect()] == [("s1", 0)]

    path, calls = f"{tmp_path}/map", []

    def discover(rows):
        return lambda: calls.append(1) or spark.createDataFrame(rows, "label string, condition string")

    assert recordings.label_map_or(spark, path, discover([])).count() == 0 and len(calls) == 1
    assert [tuple(r) for r in recordings.label_map_or(spark, path, discover([("a", "slow")])).collect()] == [("a", "slow")]
    assert [tuple(r) for r in recordings.label_map_or(spark, path, discover([("b", "fast")])).collect()] == [("a", "slow")] and len(calls) == 2
    assert [tuple(r) for r in recordings.label_map_or(spark, path, discover([("b", "fast")]), refresh=True).collect()] == [("b", "fast")]
    assert recordings.latest_version(spark, path) == 2

    (tmp_path / "m.json").write_text(json.dumps({"x": "slow", "y": "rest"}))
    assert {tuple(r) for r in recordings.label_map(spark, f"{tmp_path}/m.json").collect()} == {("x", "slow"), ("y", "rest")}
    (tmp_path / "k.json").write_text(json.dumps({"s1": {"n": 1}, "s2": {"n": 2}}))
    assert {(r.subject, r.value.n) for r in recordings.keyed_json(spark, f"{tmp_path}/k.json", "struct<n:int>").collect()} == {("s1", 1), ("s2", 2)}
    recordings.update_params(spark, f"{tmp_path}/p", back, {"fs": 1})
    assert json.loads(spark.read.text(f"{tmp_path}/p").first()[0]) == {"fs": 1}
    with pytest.raises(RuntimeError):
        recordings.update_params(spark, f"{tmp_path}/p2", back.limit(0), {})
    path = next(r.path for r in recordings.listing(spark, root, "*_events.tsv").orderBy("path").collect())
    assert recordings.event_table(spark, path).columns == ["onset", "trial_type", "extra"]


def test_event_columns(spark):
    df = spark.createDataFrame([("s", "1.5", "a", "b"), ("s", "n/a", None, "c")], "subject string, `Onset (s)` string, value string, ` Condition ` string")
    assert [tuple(r) for r in epochs.standard_events(df, ["subject"]).collect()] == [("s", 1.5, "b"), ("s", None, "c")]
    assert epochs.standard_events(df.select("subject", "value"), ["subject"]).count() == 0


def test_event_columns_of_each_file(spark):
    rows = [("a", {"onset": "1", "label": "x", "value": "y"}), ("a", {"onset": "n/a", "label": "x", "value": None}), ("b", {"time": "2.5", "label": "z"}), ("c", {"when": "1", "label": "z"}), ("d", {"onset": "1"}), ("e", None)]
    df = spark.createDataFrame(rows, "subject string, fields map<string,string>").withColumn("onset", F.lit(9))
    assert [tuple(r) for r in epochs.file_events(df, ["subject"]).orderBy("subject", F.desc("onset")).collect()] == [("a", 1.0, "y"), ("a", None, None), ("b", 2.5, "z")]
    assert epochs.file_events(df.limit(0), ["subject"]).count() == 0


def test_two_event_files(spark, tmp_path):
    """From folders with task, rest, unnamed and single files, and files of other columns, to epochs; rest epochs fall back to the task file."""
    head, lines = "onset\ttrial_type", ["10\tslow", "20\trest"]
    text = lambda *x, h=head: "\n".join([h, *x]) + "\n"
    folders = {
        "sub-1": {"verbalwm": text(*lines), "rest": text("30\trest", "40\tslow")},  # each its own; a rest file's task is none
        "sub-2": {"verbalwm": text(*lines), "rest": text("30\tother")},  # no rest there: from the task file
        "sub-3": {"one": text(*lines)},  # the only file serves both
        "sub-4": {"rest": text("30\trest"), "zz": text("50\tfast")},  # the other one is the task's
        "sub-5": {"aa": text(*lines), "bb": text("60\trest")},  # nothing named: the registry's first, as task only
        "sub-6": {"verbalwm": text(*lines), "other": text("70\trest\tslow", h="Time\t Condition \tcondition")},  # the other is rest, by its own columns
        "sub-7": {"verbalwm": text(*lines, h="when\ttrial_type"), "rest": text("30\trest")},  # no onset column: no task epochs
        "sub-8": {"verbalwm": text(*lines), "rest": text("n/a\trest")},  # a missing onset
    }
    for s, files in folders.items():
        (tmp_path / s / "eeg").mkdir(parents=True)
        for name, body in files.items():
            (tmp_path / s / "eeg" / f"{s}_task-{name}_events.tsv").write_text(body)
    listing = recordings.listing(spark, str(tmp_path)).select("subject", "path")
    first = listing.groupBy("subject").agg(F.min("path").alias("events_path"))
    tables = recordings.event_tables(spark, listing.where(F.endswith("path", F.lit("_events.tsv"))))
    events = preprocess.events_of_files(tables, epochs.event_files(listing, first))
    rec = listing.select("subject", F.lit(1.0).alias("fs"), F.lit(100).cast("long").alias("n_samples")).distinct()
    got = preprocess.epochs_of_files(events, rec, spark.createDataFrame([], "label string, condition string"), Params(fs=1.0, tmin=0.0, tmax=5.0))
    want = {(f"sub-{s}", k, o) for s, k, o in [(1, "task", 10), (1, "rest", 30), (2, "task", 10), (2, "rest", 20), (3, "task", 10), (3, "rest", 20), (4, "task", 50), (4, "rest", 30), (5, "task", 10), (5, "rest", 20), (6, "task", 10), (6, "rest", 70), (7, "rest", 30)]}
    assert {(r.subject, r.kind, r.onset_samp) for r in got.collect()} == want and got.count() == len(want)


def test_resample():
    t = np.arange(8)
    assert np.allclose(kernels.resample(np.cos(np.pi * t), 16), np.cos(np.pi * np.arange(16) / 2))
    assert np.allclose(kernels.resample(np.cos(np.pi * np.arange(16) / 2), 8), np.cos(np.pi * t))
    for m, n in ((20, 33), (33, 20), (20, 30), (30, 20), (21, 63)):
        x = lambda k, of: 1 + np.cos(2 * np.pi * 3 * np.arange(k) / of)
        assert np.allclose(kernels.resample(x(m, m), n), x(n, n))


def test_resampled(spark):
    df = spark.createDataFrame([("a", 8.0, 8, np.cos(np.pi * np.arange(8)).tolist()), ("b", 16.0, 3, [1.0, 2.0, 3.0])], "subject string, fs double, n_samples long, samples array<double>")
    got = {r.subject: r for r in hest.resampled(df, 16.0).collect()}
    assert got["b"].samples == [1.0, 2.0, 3.0] and got["a"].n_samples == 16 and got["a"].fs == 16.0 and np.allclose(got["a"].samples, np.cos(np.pi * np.arange(16) / 2))


def plain_pulse(x, peaks, fs):
    if len(peaks) < 3:
        return dict.fromkeys(PPG_FEATURES, 0.0)
    ibi = np.diff(peaks) / fs * 1000
    slope, base = np.polyfit(np.arange(len(ibi)), ibi, 1)
    rest, total = ((ibi - slope * np.arange(len(ibi)) - base) ** 2).sum(), ((ibi - ibi.mean()) ** 2).sum()
    seg = [x[a:b] for a, b in zip(peaks[:-1], peaks[1:], strict=True) if b - a >= 5]
    amp, area = [np.ptp(s) for s in seg], [((s[1:] + s[:-1]) / 2).sum() / fs for s in seg]
    wide = [np.flatnonzero(s >= s.min() + np.ptp(s) / 2) for s in seg]
    values = (ibi.mean(), np.ptp(ibi), slope, 1 - rest / (total + 1e-8), ibi.std() / (ibi.mean() + 1e-8), np.diff(ibi).mean(), np.mean(amp), np.var(amp), np.mean([s.argmax() / fs * 1000 for s in seg]), np.mean([(w[-1] - w[0]) / fs * 1000 for w in wide]), np.mean(area), np.var(area))
    return dict(zip(PPG_FEATURES, values, strict=True))


def test_ppg_features(spark):
    rng = np.random.default_rng(1)
    t = np.arange(1200)
    signals = {"a": np.sin(2 * np.pi * t / 97) + 0.1 * rng.standard_normal(1200), "b": np.sin(2 * np.pi * t / 140) * (1 + t / 2000), "short": t[:15] * 1.0, "flat": np.zeros(300)}
    df = spark.createDataFrame([(k, [float(v) for v in x]) for k, x in signals.items()], "k string, ppg array<double>")
    got = {r.k: r for r in hest.ppg_features(df, ["k"], 100.0).collect()}
    assert got["short"].error and got["short"].ibi_mean is None
    for k in ("a", "b", "flat"):
        x = kernels.filtfilt(*kernels.butter(3, 0.5, 8.0, 100.0), signals[k])[0]
        peaks = kernels.find_peaks(x, 40, 0.3 * x.std())
        want = plain_pulse(x, peaks, 100.0)
        assert got[k].error is None and (len(peaks) >= 3) == (k != "flat")
        for name in PPG_FEATURES:
            assert got[k][name] == pytest.approx(want[name], rel=1e-6, abs=1e-6), (k, name)


def test_filter_is_zero_phase_and_keeps_the_band():
    t = np.arange(4000) / 200.0
    x = np.sin(2 * np.pi * 3 * t) + np.sin(2 * np.pi * 60 * t)
    y = kernels.filtfilt(*kernels.butter(3, 0.5, 8.0, 200.0), x)[0]
    assert np.abs(y - np.sin(2 * np.pi * 3 * t))[400:-400].max() < 0.05
    with pytest.raises(ValueError):
        kernels.filtfilt(*kernels.butter(3, 0.5, 8.0, 200.0), x[:21])


def test_peaks_by_definition():
    x = np.array([0, 3, 0, 2, 2, 2, 0, 5, 0, 1, 0.0])
    assert kernels.find_peaks(x, 1, 0).tolist() == [1, 4, 7, 9] and kernels.find_peaks(x, 4, 0).tolist() == [1, 7] and kernels.find_peaks(x, 1, 2.5).tolist() == [1, 7]


def test_r_peaks_and_beat_tensor():
    fs = 250.0
    t = np.arange(1500)
    ecg = np.exp(-(((t % 200) - 100) ** 2) / 16.0)
    peaks = kernels.clean_peaks(kernels.r_peaks(ecg, fs))
    assert np.abs((peaks % 200) - 100).max() <= 1 and np.all(np.diff(peaks) > 0)
    out, n, rr = kernels.beat_tensor([np.sin(t / 10.0), None], ecg, fs)
    assert out.shape[:2] == (2, 4) and n >= 5 and np.allclose(rr, 800, atol=5) and (out[1] == 0).all() and np.isfinite(out).all()
    theta, alpha = (kernels.band_kernel(b, 1000.0)[0] for b in ("theta", "alpha_low"))  # the frequency is ignored, so they are one wave
    k = min(len(theta), len(alpha)) // 2 - 1
    a, b = (x[len(x) // 2 - k : len(x) // 2 + k] for x in (theta, alpha))
    assert np.allclose(a, b, atol=1e-9)


def test_representations_end_to_end(spark, tmp_path):
    """Tensors of epochs, their own rest, quality and files, against the same computed here."""
    p = Params(fs=250.0, targets=("Fz", "Cz"))
    rng = np.random.default_rng(3)
    t = np.arange(1500)
    ecg = np.exp(-(((t % 200) - 100) ** 2) / 16.0)
    keys = [("a", "rest", 0), ("a", "rest", 1), ("a", "task", 0), ("a", "task", 1), ("b", "task", 0), ("c", "task", 0), ("c", "task", 1)]
    ecgs = {k: (ecg + 0.01 * rng.standard_normal(1500)).astype(np.float32) for k in keys} | {("c", "task", 1): ecg[:9].astype(np.float32)}
    eegs = {k: rng.standard_normal(len(ecgs[k])).astype(np.float32) for k in keys}
    floats = lambda x: [float(v) for v in x]
    epochs_ = spark.createDataFrame([(*k, "fast", 2, p.fs, floats(ecgs[k])) for k in keys], "subject string, kind string, epoch_idx int, condition string, label_int int, fs double, ecg array<float>")
    eeg = spark.createDataFrame([(*k, "cz", floats(eegs[k])) for k in keys], "subject string, kind string, epoch_idx int, channel string, samples array<float>")
    cmap = spark.createDataFrame([(s, *x) for s in "abc" for x in (("Fz", 0, "ZERO_PLACEHOLDER", "placeholder", -1), ("Cz", 1, "cz", "case_insensitive", 0))], "subject string, target string, target_pos int, mapped_to string, method string, ch_pos int")
    rep = hest.representations(epochs_, eeg, cmap, p)
    tensor = {k: kernels.beat_tensor([None, eegs[k].astype(float)], ecgs[k].astype(float), p.fs) for k in keys if len(ecgs[k]) > 100}
    got = {(r.subject, r.kind, r.epoch_idx): r for r in rep.collect()}
    assert got["c", "task", 1].error and all(np.allclose(got[k].hest, tensor[k][0].reshape(-1)) and got[k].n_beats == tensor[k][1] for k in tensor)
    norm = hest.normalized(rep, p)
    rest = np.stack([tensor["a", "rest", k][0].reshape(-1) for k in (0, 1)])
    rows = {(r.subject, r.epoch_idx): r for r in norm.collect()}
    assert rows.keys() == {("a", 0), ("a", 1), ("b", 0)}  # c has an epoch that fails
    for k in (0, 1):
        want = (tensor["a", "task", k][0].reshape(-1) - rest.mean(axis=0)) / (rest.std(axis=0) + 1e-8)
        assert np.allclose(rows["a", k].hest_norm, want, rtol=1e-4, atol=1e-4) and rows["a", k].norm_status == "rest"
        assert len(rows["a", k].rr_sequence) == 10 and np.allclose(rows["a", k].rr_sequence[:5], tensor["a", "task", k][2][:5])
    assert np.allclose(rows["b", 0].hest_norm, tensor["b", "task", 0][0].reshape(-1), rtol=1e-5) and rows["b", 0].norm_status == "unnormalized"
    q = {r.subject: r for r in hest.hest_qc(rep, norm, cmap, p).collect()}
    assert (q["a"].status, q["a"].n_task, q["a"].n_rest, q["a"].conditions, q["a"].n_placeholder_ch) == ("success", 2, 2, {"fast": 2}, 1) and q["a"].channel_map["Cz"].mapped_to == "cz"
    assert (q["c"].status, q["c"].n_task) == ("skip", 0) and q["c"].skip_reason
    back = hest.write_results(norm, hest.rest_stats(rep, p), cmap, p, f"{tmp_path}/hest")
    assert back.count() == 3 and json.loads(spark.read.text(f"{recordings.published(spark, f'{tmp_path}/hest')}/attributes").first()[0])["n_times"] == 40
    assert spark.read.parquet(f"{recordings.published(spark, f'{tmp_path}/hest')}/rest_stats").first().subject == "a"
    with pytest.raises(RuntimeError):
        hest.write_results(norm, hest.rest_stats(rep, p), cmap, Params(fs=256.0, targets=("Fz", "Cz")), f"{tmp_path}/hest")
    kept = recordings.published(spark, f"{tmp_path}/hest")
    assert spark.read.parquet(f"{kept}/task").count() == 3  # the check failed, and the version before is still the one to read
    traces = hest.band_traces(recordings.first_epoch(back, hest.hest_qc(rep, norm, cmap, p)), p.n_times).collect()
    assert len(traces) == 160 and all(np.isclose(r.value, rows["a", 0].hest_norm[r.band * 40 + r.time] + 2 * r.band) for r in traces)


def test_publish(spark, tmp_path):
    path = str(tmp_path / "stage")
    with pytest.raises(FileNotFoundError):
        recordings.published(spark, path)
    put = lambda n: lambda folder: spark.range(n).write.parquet(f"{folder}/t")
    read = lambda: spark.read.parquet(f"{recordings.published(spark, path)}/t").count()
    recordings.publish(spark, path, put(3))
    assert read() == 3

    def killed(folder):
        put(9)(folder)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        recordings.publish(spark, path, killed)
    (tmp_path / "stage" / "manifest" / "2").mkdir()  # a row that was not finished
    assert read() == 3
    recordings.publish(spark, path, put(4))
    assert read() == 4 and (tmp_path / "stage" / "manifest" / "3" / "_SUCCESS").exists()


def test_components(spark):
    """A planted heart component goes; a frontal one stays; short recordings and those without ECG are skipped."""
    rng = np.random.default_rng(11)
    fs, n = 100.0, 3000
    t = np.arange(n) / fs
    names = ["Pz", "O1", "P3", "Fz", "F4", "Cz"]
    own = rng.laplace(size=(4, n))
    own = np.array([np.convolve(s, np.ones(5) / 5, mode="same") for s in own])
    clean = rng.standard_normal((6, 4)) @ own
    heart = np.exp(-(((t % 0.83) - 0.4) ** 2) / 0.001)
    high = np.array([3.0, 2.5, 2.8, 0.3, 0.2, 0.5])
    out, info = kernels.remove_artifacts(clean + 4 * high[:, None] * heart, names, heart, None, fs)
    want = clean - clean.mean(axis=1, keepdims=True)
    assert info["ica_n_excluded"] == 1 and not info["ica_skipped"] and not info["ica_posterior_check_failed"]
    assert np.corrcoef((out - out.mean(axis=1, keepdims=True)).ravel(), want.ravel())[0, 1] > 0.99
    low = high[[3, 4, 5, 0, 1, 2]]
    out, info = kernels.remove_artifacts(clean + 4 * low[:, None] * heart, names, heart, None, fs)
    assert info["ica_n_excluded"] == 0 and info["ica_posterior_check_failed"] and np.allclose(out, clean + 4 * low[:, None] * heart, atol=1e-6)
    assert kernels.remove_artifacts(clean[:, :1900], names, heart[:1900], None, fs)[1]["ica_skip_reason"] == "too_short"
    assert kernels.remove_artifacts(clean, names, None, None, fs)[1]["ica_skip_reason"] == "no_ecg"


def test_cleaned_recordings(spark):
    """Mains and drift go, the reference is the mean; without an ECG no component is looked for."""
    rng = np.random.default_rng(5)
    fs, n = 100.0, 2600
    t = np.arange(n) / fs
    x = {"Fz": np.sin(2 * np.pi * 10 * t), "Pz": np.sin(2 * np.pi * 6 * t), "Cz": np.sin(2 * np.pi * 15 * t)}
    rows = [("s", c, i, "eeg", fs, [float(v) for v in y + 5 + 0.01 * rng.standard_normal(n)]) for i, (c, y) in enumerate(x.items())]
    short = [("q", c, i, "eeg", fs, [float(v) for v in y[:900]]) for i, (c, y) in enumerate(x.items())]
    df = spark.createDataFrame(rows + short, "subject string, channel string, ch_pos int, ch_type string, fs double, samples array<double>")
    got = {(r.subject, r.channel): r for r in hest.cleaned_recordings(df).collect()}
    assert len(got) == 6 and {r.ica_skip_reason for r in got.values()} == {"no_ecg"}
    stack = np.stack([got["s", c].samples for c in x])
    assert np.allclose(stack.sum(axis=0), 0, atol=1e-6) and np.abs(stack.mean(axis=1)).max() < 0.05
    want = np.stack(list(x.values()))
    want = want - want.mean(axis=0)
    assert np.corrcoef(stack[:, 300:-300].ravel(), want[:, 300:-300].ravel())[0, 1] > 0.98


def test_subject_sets_and_modes(spark):
    rows = [("a", "x", 1), ("a", "y", 2), ("a", "y", 3), ("a", "x", 4), ("b", None, 1)]
    df = spark.createDataFrame(rows, "k string, v string, pos int")
    assert [tuple(r) for r in registry.mode_first_seen(df, ["k"], "v", "pos").collect()] == [("a", "x", 2)]
    assert {tuple(r) for r in registry.frequency(df, "v").collect()} == {("x", 2), ("y", 2)}


def test_ingest_picks_up_new_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.tsv").write_text("onset\tlabel\n1\tretention_slow\n2\tRest\n")
    args = (str(src), "onset double, label string", f"{tmp_path}/out", f"{tmp_path}/ck")
    ingest.ingest(spark, *args)
    (src / "b.tsv").write_text("onset\tlabel\n3\tfast_delay\n")
    ingest.ingest(spark, *args)
    assert {(r.onset, r["name"], r.code, r.is_rest) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(1.0, "slow", 1, False), (2.0, "rest", -1, True), (3.0, "fast_delay", 3, False)}
