"""Comparison of a query with its SQL on the same Parquet tables."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows):
    def one(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return "~"
        if isinstance(v, float):
            return f"{v:.4f}".replace("-0.0000", "0.0000")
        return str(v)

    return sorted(tuple(map(one, r)) for r in rows)


def compare(spark, name, sf):
    import __spark_entry__ as e

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(e.oracle_sql()[name]).df()
    got = e.queries()[name](spark, sf).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a, b = canonical(got[cols].itertuples(index=False)), canonical(want[cols].itertuples(index=False))
    assert len(a) == len(b), (len(a), len(b))
    assert a == b, next((x, y) for x, y in zip(a, b) if x != y)
