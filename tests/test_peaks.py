import numpy as np
import pytest
from pyspark.sql import functions as F

from beatloom.functions import kernels
from beatloom.operators import peaks, ranges, windows


def signals():
    rng = np.random.default_rng(3)
    t = np.arange(700)
    return {
        "random": rng.standard_normal(900), "ties": rng.integers(0, 4, 800).astype(float), "plateaus": np.repeat(rng.integers(0, 6, 200), rng.integers(1, 6, 200)).astype(float),
        "rising": t * 1.0, "falling": -t * 1.0, "flat": np.zeros(300), "stairs": t / 10 + (t % 2), "waves": np.sin(t / 9) + 0.2 * np.sin(t / 2.3), "one": np.zeros(1), "two": np.array([1.0, 2.0]),
    }


def rows(spark, s):
    return spark.createDataFrame([(k, i, float(v), "x") for k, x in s.items() for i, v in enumerate(x)], "k string, pos long, value double, extra string")


@pytest.mark.parametrize("distance, least, size, block", [(1, 0.0, 64, 8), (5, 0.4, 64, 4), (17, 1.0, 100, 8), (7, 0.0, 65536, 64)])
def test_peaks_equal_the_definition(spark, distance, least, size, block):
    s = signals()
    got = peaks.find(rows(spark, s), ["k"], distance, size, block).where(F.col("prominence") >= least).collect()
    for k, x in s.items():
        assert sorted(r.pos for r in got if r.k == k) == kernels.find_peaks(x, distance, least).tolist(), k


def test_prominence_by_plain_scan(spark):
    x = np.random.default_rng(5).integers(0, 30, 1500).astype(float)
    for r in peaks.find(rows(spark, {"a": x}), ["k"], 1, 100, 6).collect():
        sides = []
        for side in (x[: r.pos][::-1], x[r.pos + 1 :]):
            higher = np.flatnonzero(side > x[r.pos])
            sides.append(min([x[r.pos], *side[: higher[0] if len(higher) else None]]))
        assert r.prominence == x[r.pos] - max(sides)


def test_empty_and_missing_samples(spark):
    none = rows(spark, {"a": np.zeros(1)}).where("false")
    assert peaks.find(none, ["k"], 3).count() == 0
    gap = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("a", 2, None), ("a", 3, 2.0), ("b", 0, None)], "k string, pos long, value double")
    assert [(r.k, r.pos, r.prominence) for r in peaks.find(gap, ["k"], 2).collect()] == [("a", 1, 1.0)]


def test_ranges_give_the_rows_of_one_window(spark):
    rng = np.random.default_rng(7)
    s = {"hot": rng.integers(0, 9, 4000), **{f"u{i}": rng.integers(0, 9, 400) for i in range(20)}}
    df = rows(spark, s)
    for name, f in {
        "diff": lambda d, n: windows.diff(d, ["k"], "pos", "value", size=n), "mean": lambda d, n: windows.moving_average(d, ["k"], "pos", "value", 7, size=n),
        "maxima": lambda d, n: windows.local_maxima(d, ["k"], "pos", "value", size=n), "segments": lambda d, n: windows.segments(d.where("value > 4"), ["k"], "pos", 2, size=n),
        "clean": lambda d, n: windows.clean_beats(d.withColumn("t", F.col("pos") * F.col("pos") % 997), ["k"], "pos", "t", size=n),
        "carried": lambda d, n: ranges.carried(d.withColumn("w", F.when(F.col("value") > 7, F.col("pos"))), ["k"], "pos", "w", "v", n),
    }.items():
        one, many = (sorted(map(str, f(df, n).collect())) for n in (10**6, 128))
        assert one == many, name
    sizes = [r["count"] for r in ranges.halo(df, ["k"], "pos", 3, 3, 128).groupBy("k", "__range").count().collect()]
    assert max(sizes) <= 2 * np.median(sizes)


def test_numbers_of_a_hot_key(spark):
    """A third of all rows have one key, some come in bursts: numbers as of one window, and no range over its size."""
    rng = np.random.default_rng(9)
    when = np.concatenate([rng.integers(0, 10**9, 2000), 5 * 10**8 + rng.integers(0, 5000, 1000), *[rng.integers(0, 10**9, 100) for _ in range(60)]])
    key = ["hot"] * 3000 + [f"u{i}" for i in range(60) for _ in range(100)]
    df = spark.createDataFrame([(k, int(w), i) for i, (k, w) in enumerate(zip(key, when, strict=True))], "k string, us long, id long")
    size = ranges.width(df, ["k"], "us", 128)
    got = {r.id: (r.n, r.first) for r in ranges.numbered(df, ["k"], "us", ["id"], "n", "first", size).collect()}
    for k in ("hot", "u3"):
        mine = sorted((int(w), i) for i, (o, w) in enumerate(zip(key, when, strict=True)) if o == k)
        assert [got[i] for _, i in mine] == [(n, mine[0][0]) for n in range(len(mine))]
    counts = [r["count"] for r in df.groupBy("k", F.floor(F.col("us") / size)).count().collect()]
    assert max(counts) <= 128 and ranges.width(df, ["k"], "us", 10**6) >= 2**29
    assert ranges.width(df.withColumn("us", F.lit(7)), ["k"], "us", 5) == 1 and ranges.width(df.where("false"), ["k"], "us") == 1
