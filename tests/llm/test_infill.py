"""Fill-in-middle against slices by a regular expression."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from beatloom.llm import infill
from tests.conftest import SF
from tests.oracle import compare

TEXTS = [None, "", "\n", "one", "a\nb\n\nc", "é😀\nß\r\n\x00x", "has <S> inside\nx", "<\nP>\n<", "\n\n\n", "z" * 5000 + "\n" + "y\n" * 3000]


def plain(doc_id, text):
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or re.search("<[PSM]>", text):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_against_sql(spark):
    compare(spark, "op12_fill_in_middle", SF)


def test_odd_texts(spark):
    rows = [(None if i == 13 else i * 10**17, t) for i, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("output", F.lit(1))
    out = infill.fill_in_middle(df)
    out = out.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    assert sorted((tuple(r) for r in out), key=key) == sorted(((i, *plain(i, t), t or "") for i, t in rows), key=key)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(df.limit(0)).count() == 0


def test_rates():
    h = infill.draws("5")
    assert infill.transformed("a\nb", h, rate=0)[1] == "plain"
    assert infill.transformed("a\nb", h, spm_rate=0)[1] == "psm" and infill.transformed("a\nb", h, spm_rate=100)[1] == "spm"


@pytest.mark.parametrize("block", [1, 2, 3, 7, 100])
def test_blocks_of_long_texts(block):
    for t in TEXTS[1:]:
        t = t[-300:]
        ends, at = [], 0
        for u in re.findall(r"[^\n]*\n|[^\n]+", t):
            at += len(u)
            ends.append(at)
        assert infill.unit_ends(t, block).tolist() == ends
