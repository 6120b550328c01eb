"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import groupjoin, infill, langid, lzprint, media, mixing, neardup, packing, preferences, sharding, toxicity, turnrepair, warc


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        sharding.op1_virtual_slots, packing.op2_best_fit_packing, preferences.op3_preference_pairs, warc.op4_arc_to_warc, lzprint.op5_lz_fingerprint,
        neardup.op6_hyperminhash, media.op7_webp_media, toxicity.op8_kneser_ney_toxicity, langid.op9_mixture_langid, mixing.op10_hash_threshold_mix,
        turnrepair.op11_turn_repair, infill.op12_fill_in_middle, groupjoin.op13_group_join,
    )
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op3_preference_pairs": preferences.OP3_SQL, "op4_arc_to_warc": warc.OP4_SQL, "op10_hash_threshold_mix": mixing.OP10_SQL, "op11_turn_repair": turnrepair.OP11_SQL, "op12_fill_in_middle": infill.OP12_SQL}
