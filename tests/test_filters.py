"""The chunked zero-phase filter against a filter of the whole signal, step by step."""

from decimal import Decimal, getcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatloom.functions import kernels
from beatloom.operators import filters


def stepwise(b, a, x, steady_on):
    """One sample after another, by the difference equation in 40 digits, from the state that a steady input leads to."""
    getcontext().prec = 40
    b, a, x = ([Decimal(float(v)) for v in w] for w in (b, a, x))
    level, n = sum(b) / sum(a), len(a) - 1
    # of a steady input u, output level * u: what is still to come of it
    z = [sum((b[i] - level * a[i] for i in range(k + 1, n + 1)), Decimal(0)) * Decimal(float(steady_on)) for k in range(n)]
    out = []
    for v in x:
        y = b[0] * v + z[0]
        z = [(z[k + 1] if k < n - 1 else 0) + b[k + 1] * v - a[k + 1] * y for k in range(n)]
        out.append(float(y))
    return np.array(out)


def plain(b, a, x):
    pad = 3 * max(len(a), len(b))
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    y = stepwise(b, a, ext, ext[0])
    y = stepwise(b, a, y[::-1], y[-1])
    return y[::-1][pad:-pad]


#: Of the last ones, bands far below the rate, the coefficients' own digits say little more.
SHAPES = [(3, 0.5, 8.0, 20.0), (3, 5.0, 40.0, 250.0), (3, 0.5, 8.0, 250.0), (4, 1.0, 40.0, 500.0), (3, 0.5, 8.0, 1000.0)]


@pytest.mark.parametrize("shape", SHAPES)
def test_blocks_equal_steps(shape):
    b, a = kernels.butter(*shape)
    x, near = np.random.default_rng(1).standard_normal(1000) + 3, 1e-6 if shape[3] == 1000.0 else 1e-8 if shape[3] == 500.0 else 1e-9
    assert np.allclose(kernels.filtfilt(b, a, x)[0], plain(b, a, x), rtol=0, atol=near)
    zero = np.zeros((1, len(a) - 1))
    y, _ = kernels.run_filter(b, a, x[None, :], zero)
    assert np.allclose(y[0], stepwise(b, a, x, 0), rtol=0, atol=near)
    head, z = kernels.run_filter(b, a, x[None, :77], zero)
    assert np.allclose(np.concatenate([head[0], kernels.run_filter(b, a, x[None, 77:], z)[0][0]]), y[0], rtol=0, atol=1e-12)


def rows(signals, chunk):
    return [(k, c, x[c * chunk : (c + 1) * chunk].tolist()) for k, x in signals.items() for c in range(-(-len(x) // chunk))]


@pytest.mark.parametrize("chunk, run", [(1, 16), (7, 4), (7, 4096), (64, 2), (4096, 4096)])
def test_chunks_equal_the_whole(spark, monkeypatch, chunk, run):
    """Chunks of one sample, last chunks that are shorter, one chunk in all, a recording as long as the padding (null) and one sample longer."""
    monkeypatch.setattr(filters, "RUN", run)
    rng = np.random.default_rng(chunk)
    b, a = kernels.butter(3, 0.5, 8.0, 20.0)
    signals = {"long": rng.standard_normal(500).cumsum(), "even": np.sin(np.arange(7 * 64) / 9.0) + 2, "least": rng.standard_normal(22), "short": rng.standard_normal(21), "one": np.ones(1), "flat": np.zeros(100)}
    df = spark.createDataFrame(rows(signals, chunk), "rec string, chunk_idx long, samples array<double>").withColumn("n", F.lit(1))
    got = filters.zero_phase(df, ["rec"], chunk, b, a).collect()
    assert len(got) == df.count()
    for k, x in signals.items():
        own = [r.samples for r in sorted((r for r in got if r.rec == k), key=lambda r: r.chunk_idx)]
        if len(x) < 22:
            assert all(v is None for v in own)
        else:
            assert np.allclose(np.concatenate(own), plain(b, a, x), rtol=0, atol=1e-9), k


def test_nulls_and_empty_tables(spark):
    b, a = kernels.butter(3, 5.0, 40.0, 250.0)
    x = [float(v) for v in range(60)]
    df = spark.createDataFrame([("s", 1, 0, x[:30]), ("s", 1, 1, [None, *x[31:]]), ("s", 2, 0, x[:30]), ("s", 2, 1, x[30:])], "rec string, ch int, chunk_idx long, samples array<double>")
    got = {(r.ch, r.chunk_idx): r.samples for r in filters.zero_phase(df, ["rec", "ch"], 30, b, a).collect()}
    assert all(v is None for c in (0, 1) for v in got[1, c]) and np.allclose(got[2, 0] + got[2, 1], plain(b, a, np.array(x)), atol=1e-9)
    assert filters.zero_phase(df.limit(0), ["rec", "ch"], 30, b, a).count() == 0
