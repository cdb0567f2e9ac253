"""The queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import fingerprint, html, infill, langid, mixing, nearjoin, packing, phrases, pii, quality, sharding, substring, tokens, wavelet
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared_in_order(documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.marked(documents(spark, sf_dir), least_words=1)  # every line that repeats, and passages across lines


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(documents(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rated(documents(spark, sf_dir))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.near_duplicates(documents(spark, sf_dir)).drop("k")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir))


def op9_wavelet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.encoded_and_read(spark, documents(spark, sf_dir), tokens.public("byte_bpe_50k.json"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), tokens.public("word_bpe_49k.json"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.transformed(documents(spark, sf_dir))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "pipeline": corpus_pipeline.run,
    "op1_fingerprints": op1_fingerprints,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language": op3_language,
    "op4_sharding": op4_sharding,
    "op5_main_text": op5_main_text,
    "op6_mixing": op6_mixing,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_quality": op8_quality,
    "op9_wavelet_files": op9_wavelet_files,
    "op10_packing": op10_packing,
    "op11_collocations": op11_collocations,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_personal_data": op13_personal_data,
}

SQL: dict[str, str] = {"op6_mixing": mixing.SQL, "op11_collocations": phrases.SQL, "op12_fill_in_middle": infill.SQL}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
