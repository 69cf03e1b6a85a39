"""The queries of this subpackage: opN_<name> applies operator N to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .byte_bpe import byte_bpe
from .clustering import cluster_vectors
from .common import read_table
from .fill_middle import fill_in_middle, restore_middle
from .langid import identify_language
from .license_scan import scan_licenses
from .mixing import mix_sources
from .near_dup import near_duplicates
from .neighbours import nearest
from .quality import score_quality
from .quality_rules import quality_rules
from .suffix_dups import remove_repeated_passages
from .token_counts import count_tokens
from .window_dups import remove_repeated_windows


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), "quality", threshold=0.3)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(read_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3)


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), most=2)


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op7_window_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(read_table(spark, sf_dir, "documents"), length=50)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op10_suffix_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_passages(read_table(spark, sf_dir, "documents"), length=100)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = restore_middle(fill_in_middle(read_table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50))
    digest = lambda c: F.sha2(F.col(c), 256).alias(f"{c}_sha256")
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"), threshold=0.8)


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(read_table(spark, sf_dir, "embeddings"), clusters=40, rounds=5, width=64, seed=2)


def queries() -> dict:
    found = (op1_quality, op2_langid, op3_mixing, op4_near_dup, op5_neighbours, op6_token_counts, op7_window_dups, op8_quality_rules, op9_byte_bpe, op10_suffix_dups, op11_fill_middle, op12_license_scan, op13_clustering)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op11_fill_middle": oracles.FILL_MIDDLE, "op12_license_scan": oracles.license_scan(), "op13_clustering": oracles.clustering()}
