import numpy as np
from pyspark.sql import functions as F

from beatloom.operators import medians


def test_equals_the_sorted_middle(spark):
    rng = np.random.default_rng(11)
    groups = {
        "even": rng.standard_normal(1000), "odd": rng.standard_normal(1001) * 1e-7, "ties": rng.integers(-3, 4, 500).astype(float), "one": [4.5], "two": [-2.0, 7.0],
        "zeros": [0.0] * 9, "signs": [-1.0, 0.0, 0.0, 1.0], "near": 1.0 + np.arange(64) * 2.0**-50, "wide": [1e-300, 1e300, -1e300, 5e-324, 1.0, 2.0], "powers": [2.0**k for k in range(-20, 21)],
    }
    rows = [(k, float(v), "x") for k, x in groups.items() for v in x] + [("even", None, "x"), ("none", None, "x")]
    df = spark.createDataFrame(rows, "k string, v double, extra string")
    for small in (0, medians.SMALL):
        got = {r.k: r.m for r in medians.exact(df, ["k"], "v", "m", small=small).collect()}
        assert got == {k: float(np.median(x)) for k, x in groups.items()}


def test_no_group_holds_a_keys_values(spark):
    """Of 100,000 values of one key the windows see only prefixes."""
    df = spark.range(100_000).select(F.lit("hot").alias("k"), (F.rand(5) * 4 + 1).alias("v")).union(spark.range(11).select(F.lit("cold"), F.col("id").cast("double")))
    df = spark.createDataFrame(df.toPandas(), "k string, v double")
    got = {r.k: r.m for r in medians.exact(df, ["k"], "v", "m").collect()}
    want = {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert got == want
    plan = medians.exact(df, ["k"], "v", "m")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "median(" not in plan and "percentile" not in plan and "collect_list" not in plan


def test_empty(spark):
    assert medians.exact(spark.createDataFrame([], "k string, v double"), ["k"], "v", "m").count() == 0
