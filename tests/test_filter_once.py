"""The chunked filter works out what it is given once, whatever is asked of its result; odd chunks."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from beatloom.functions import kernels
from beatloom.operators import filters

BAND = kernels.butter(3, 0.5, 8.0, 20.0)
CHUNKS = "rec string, chunk_idx long, samples array<double>"


def test_chunks_and_output_are_worked_out_once(spark):
    seen, x = spark.sparkContext.accumulator(0), np.sin(np.arange(90) / 5.0)

    def count(batches):
        for g in batches:
            seen.add(len(g))
            yield g

    df = spark.createDataFrame([("s", k, x[k * 16 : (k + 1) * 16].tolist()) for k in range(6)], CHUNKS).mapInPandas(count, CHUNKS)
    out = filters.zero_phase(df, ["rec"], 16, *BAND).select("rec", "chunk_idx", F.posexplode("samples").alias("i", "v"))
    got = [r.v for r in out.orderBy("chunk_idx", "i").collect()]
    assert seen.value == 6
    assert np.allclose(got, kernels.filtfilt(*BAND, x)[0], rtol=0, atol=1e-9)
    lines = [line for line in out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines() if " both(" in line]
    assert len(lines) == 1 and "MapInArrow" in lines[0]


def test_odd_chunks(spark):
    """Keys of other kinds, chunks of many lengths in a batch, single precision, an empty last chunk, recordings without samples, nulls and values that are no numbers."""
    rng, day = np.random.default_rng(5), datetime.date(2024, 5, 6)
    signals = {(day, k): rng.standard_normal(n).cumsum() for k, n in enumerate((22, 23, 31, 32, 33, 64, 90))}
    rows = [(*key, c, x[c * 16 : (c + 1) * 16].tolist()) for key, x in signals.items() for c in range(-(-len(x) // 16))]
    rows += [(day, 3, 2, []), (day, 90, 0, []), (day, 91, 0, None)]
    rows += [(day, 92, 0, [1.0] * 8 + [float("nan")] + [1.0] * 7), (day, 92, 1, [1.0] * 16), (day, 93, 0, [None] * 16), (day, 93, 1, [1.0] * 16)]
    df = spark.createDataFrame(rows, "day date, ch int, chunk_idx int, samples array<float>")
    got = {(r.ch, r.chunk_idx): r.samples for r in filters.zero_phase(df, ["day", "ch"], 16, *BAND).collect()}
    assert len(got) == len(rows)
    for (_, k), x in signals.items():
        own = np.concatenate([got[k, c] for c in range(-(-len(x) // 16))])
        assert np.allclose(own, kernels.filtfilt(*BAND, x.astype(np.float32).astype(float))[0], rtol=0, atol=1e-9), k
    assert got[3, 2] == [] and got[90, 0] is None and got[91, 0] is None
    assert all(v is None for k in (92, 93) for c in (0, 1) for v in got[k, c])
