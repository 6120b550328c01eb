"""Contracts of the other operators on small tables."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatloom.llm import entry, packing
from tests.conftest import SF
from tests.oracle import compare

ODD = [(1, None), (2, ""), (3, "a|b don't I'M Σας ΟΔΟΣ İx ßẞ 日本語。12"), (3, "a|b don't I'M Σας ΟΔΟΣ İx ßẞ 日本語。12"), (None, "no id"), (5, "word, " * 9000), (6, "x\x1cy <|endoftext|> A.B,c!!")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("range", F.lit(1)).withColumn("shard", F.lit(9))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, name):
    compare(spark, name, SF)


def test_packing(odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack_documents(odd).toPandas()
    want = set()
    for doc_id, text in ODD:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want |= {(str(doc_id), k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))}
    null_safe = ["None" if x != x or x is None else str(int(x)) for x in got["doc_id"]]
    assert set(zip(null_safe, got["piece"], got["start"], got["length"], got["ids_crc32"], strict=True)) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        ends = (g["offset"] + g["length"]).tolist()
        assert g["offset"].tolist() == [0, *ends[:-1]] and ends[-1] <= 2048


def test_local_search_empties_bins():
    lengths = [1200, 1100, 948, 848, 700, 600, 748]
    bins = packing.local_search(lengths, [[0], [1], [2], [3], [4, 5], [6]])
    assert sorted(i for b in bins for i in b) == list(range(7)) and len(bins) < 6
    assert all(sum(lengths[i] for i in b) <= 2048 for b in bins)
