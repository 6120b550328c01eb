"""Statistics of arrays, and beat tensors of many epochs together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatloom.functions import arrays, kernels
from beatloom.params import BANDS, Params
from beatloom.plans import hest


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_stats_of_whole_arrays(spark, batch):
    """Keys with nulls, arrays of several lengths, null elements; no element is a row of its own."""
    rng = np.random.default_rng(8)
    keys = [("a", 1), ("a", None), (None, 1), ("b", 2**60 + 1), ("none", 5), ("empty", 5)]
    rows = [(*keys[min(int(rng.integers(0, 12)), 3)], [None if rng.random() < 0.1 else float(v) for v in 1e6 + rng.random(int(rng.integers(0, 9)))]) for _ in range(300)]
    rows += [("none", 5, None), ("empty", 5, []), ("empty", 5, [None, None]), ("a", 1, [None] * 12)]
    df = spark.createDataFrame(rows, "k string, n long, x array<double>").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        stats = arrays.array_stats(df, ["k", "n"], "x")
        got = {(r.k, r.n): r for r in stats.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == set(keys[:4])
    for key, r in got.items():
        of = [x for *k, x in rows if tuple(k) == key]
        at = [[x[i] for x in of if len(x) > i and x[i] is not None] for i in range(8)]
        assert np.allclose(r["mean"], [np.mean(v) for v in at], rtol=1e-14) and np.allclose(r["std"], [np.std(v) + 1e-8 for v in at], rtol=1e-7)
    assert "Generate" not in stats._jdf.queryExecution().optimizedPlan().toString()
    means = {(r.k, r.n): r["mean"] for r in arrays.array_mean(df, ["k", "n"], "x").collect()}
    assert all(np.allclose(means[k], r["mean"], rtol=1e-14) for k, r in got.items())
    assert arrays.array_stats(df.limit(0), ["k", "n"], "x").count() == 0


@pytest.mark.parametrize("mode", ["as_computed", "frequency_scaled"])
def test_powers_of_windows(mode):
    x = np.random.default_rng(2).standard_normal((3, 200))
    got = kernels.window_powers(x, 250.0, 5, mode)
    assert all(np.allclose(got[:, b], kernels.band_power(x, band, 250.0, mode)[:, ::5]) for b, band in enumerate(BANDS))


def test_epochs_together_are_epochs_alone():
    rng, t = np.random.default_rng(6), np.arange(1500)
    ecg = np.exp(-(((t % 200) - 100) ** 2) / 16.0)
    epochs = []
    for k in range(9):
        n = (1500, 1100, 12)[k % 3]
        own = rng.standard_normal(n)
        epochs.append(([own, None, own, rng.standard_normal(50 if k == 4 else n)], ecg[:n] + 0.01 * rng.standard_normal(n)))
    for (channels, own), got in zip(epochs, kernels.beat_tensors(epochs, 250.0), strict=True):
        try:
            want = kernels.beat_tensor(channels, own, 250.0)
        except ValueError:
            assert isinstance(got, ValueError)
            continue
        assert got[1] == want[1] and np.allclose(got[0], want[0]) and np.allclose(got[2], want[2]) and (got[0][1] == 0).all() and (got[0][0] == got[0][2]).all()
    assert sum(isinstance(x, ValueError) for x in kernels.beat_tensors(epochs, 250.0)) == 4


def test_tensors_are_computed_once(spark):
    """What reads the tensors reads a table. Epochs with no ECG but channels give a row without a tensor, those with neither none."""
    p, t = Params(fs=250.0, targets=("Fz", "Cz")), np.arange(1500)
    ecg = np.exp(-(((t % 200) - 100) ** 2) / 16.0).tolist()
    head = "subject string, kind string, epoch_idx int, condition string, label_int int, fs double, ecg array<float>"
    epochs = spark.createDataFrame([("a", "task", k, "fast", 2, 250.0, None if k in (70, 71) else ecg) for k in range(150)], head)
    eeg = spark.createDataFrame([("a", "task", k, "Cz", np.sin(t / (10 + k)).tolist()) for k in range(200) if k != 71], "subject string, kind string, epoch_idx int, channel string, samples array<float>")
    cmap = spark.createDataFrame([("a", "Fz", 0, "Cz", "", 0), ("a", "Cz", 1, "Cz", "exact", 0)], "subject string, target string, target_pos int, mapped_to string, method string, ch_pos int")
    rep = hest.representations(epochs, eeg, cmap, p)
    assert rep.inputFiles()
    rows = {r.epoch_idx: r for r in rep.collect()}
    assert rows.keys() == set(range(150)) - {71} and rows[70].hest is None and rows[70].n_beats == 0 and rep.count() == 149
    for k in (0, 63, 64, 149):
        want = kernels.beat_tensor([np.sin(t / (10 + k)).astype("f4").astype(float)] * 2, np.array(ecg, dtype="f4").astype(float), 250.0)
        assert np.allclose(rows[k].hest, want[0].reshape(-1)) and np.allclose(rows[k].rr, want[2])
    assert hest.normalized(rep, p).where(F.size("hest_norm") == 320).count() == 148
