"""A training corpus from `documents`: language, toxicity, near-duplicates, mix, packed sequences.

Each stage takes all that the one before kept and returns the columns of documents, the last the packed pieces.

Cases: empty texts, ties and very long texts are as each operator says; a stage that gets no rows gives none. Rows with
a null text are `und` and go in the first stage. Rows with a null id are scored, mixed and packed like any other, each on its own,
and are no near-duplicates of anything. Rows that repeat an id are one document from the third stage on. Null languages and
labels teach nothing; a null source is a source of its own. Columns beyond those of documents pass every stage but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.llm import common, langid, mixing, neardup, packing, toxicity

#: op6's contract names 85; the corpus drops copies from 80 on.
NEAR_PERCENT = 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, which no language explains, go."""
    out = langid.with_languages(docs, langid.fit(docs), "__language")
    return out.where(F.col("__language.lang") != langid.UNKNOWN).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.with_scores(docs, model, "__score").where(F.col("__score") < toxicity.THRESHOLD).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, of NEAR_PERCENT percent equal shingles and more."""
    return neardup.kept_documents(docs, NEAR_PERCENT)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.taken(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("mix", mix_stage),
    ("pack", packing_stage),
]

#: Models and sketches have no SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written as Parquet and read again; a stage's rows go once the next has read them."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            common.drop_stored(before)
        before = docs
    return docs
