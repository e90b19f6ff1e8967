"""Queries of the corpus operators over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_extract, mixing, quality_rank, quality_rules, simhash, substring_dedup, token_codec, token_count, url_filter
from .oracles import HELD, MIX


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op5_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rank.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("fp")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codec.encoded(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end=2)


def op10_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_decontaminate, op3_quality_rules, op4_html_extract, op5_quality_rank, op6_url_filter, op7_simhash, op8_token_counts, op9_token_output, op10_repeated_strings)}

#: The others have no SQL: medians by sketches, XXH64, tokenizers, Viterbi search, fitted models, and byte strings of 850 million places are beyond it. Tests hold them against plain versions.
ORACLE_SQL = {"op1_mix_sources": MIX, "op2_decontaminate": HELD}
