"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, flac, jaccard, language, mixing, mtree, packing, quality, substring, toxicity
from .common import read


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(read(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_chats(chat.with_probe(read(spark, sf_dir, "conversations"))))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(read(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(read(spark, sf_dir, "documents"))


def op8_store_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_digest(flac.store_texts(read(spark, sf_dir, "documents")))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sainte_lague_mix(read(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_top_k": op1_top_k,
        "op2_toxicity": op2_toxicity,
        "op3_language": op3_language,
        "op4_quality": op4_quality,
        "op5_format_chats": op5_format_chats,
        "op6_repeated_passages": op6_repeated_passages,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_store_media": op8_store_media,
        "op9_mix_sources": op9_mix_sources,
        "op10_jaccard_join": op10_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_top_k": mtree.ORACLE, "op5_format_chats": chat.ORACLE}
