"""Fill-in-middle by the offsets of a pre-tokenizer.

The tokenizers library's Split pre-tokenizer, with isolated matches of a pattern of lines, gives the code-point offsets of a
text's units; nothing is trained. Their number is n; two ranks, drawn from a hash of the id, pick the ends of prefix and
middle among the offsets, and the text is sliced there and put together again in one of two orders.

A row is read, cut and written by itself: no shuffle, and nothing is kept between rows. A text is cut by blocks of
BLOCK characters, so the library's own tables (tens of bytes a character) stay bounded however long it is; a unit that crosses
blocks is one unit.

Cases: a null text is empty; an empty text, or one that holds a mark, is left plain, with its number of units; a null id draws as the
empty id does; repeated ids draw the same ranks, repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Seed of the draws; of 100 documents, those that are transformed, and of these, those whose suffix comes first.
SEED, RATE, SPM_RATE = 7, 100, 50
#: Characters that the pre-tokenizer sees at once.
BLOCK = 1 << 20

OUT = "doc_id string, n long, form string, prefix_chars long, middle_chars long, output string"


@lru_cache(maxsize=4)
def _splitter(pattern: str):
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(pattern), behavior="isolated")


def unit_ends(text: str, block: int = BLOCK) -> np.ndarray:
    """Code-point offsets of the ends of a text's lines, ascending; their number is the number of lines."""
    split, ends = _splitter(LINES), []
    for start in range(0, len(text), block):
        part = text[start : start + block]
        if start and text[start - 1] != "\n":
            ends[-1] = ends[-1][:-1]  # the last line goes on
        ends.append(np.array([end + start for _, (_, end) in split.pre_tokenize_str(part)], dtype=np.int64))
    return np.concatenate(ends) if ends else np.zeros(0, dtype=np.int64)


def draws(doc_id: str | None, seed: int = SEED) -> list[int]:
    """Four numbers below 2 ** 32 from the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(text: str, h: list[int], rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of a text."""
    ends = unit_ends(text)
    n = len(ends)
    if not text or h[2] % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (int(ends[k - 1]) if k else 0 for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n, form (plain, psm, spm), prefix_chars, middle_chars and output of every document."""

    @common.in_task
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *transformed(t or "", draws(i, seed), rate, spm_rate)) for i, t in zip(batch["doc_id"], batch["text"], strict=True)]
            out = pd.DataFrame(rows, columns=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(run, OUT)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    prefix, suffix = (F.when(form == "psm", part[i]).otherwise(part[3 - i]) for i in (1, 2))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, part[3], suffix))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, transformed with the default parameters, as digests of the outputs and of the texts rebuilt from them."""
    out = fill_in_middle(common.table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
        CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM h),
p AS (SELECT doc_id, text, n, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
